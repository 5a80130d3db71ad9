"""Language-model scores by Katz backoff over words.

P(w | h) is the discounted share of a pair seen after h, else a(h) * P(w); P(w) is the discounted share of
a seen word, else the mass that discounting left, which all unseen words share as one event.  Discounts are
Good-Turing's for counts up to ``TOP``; a(h) makes each P(. | h) sum to 1 exactly.  Every word and every
pair of the training texts counts, those seen once too.

Texts are held as blocks: a sorted dictionary of word hashes and the places of the tokens in it.  Blocks ask
by ranges of hashes and get packed answers in the order asked: the training count of each of their words
and pairs, with a mark in one of the blocks that hold a pair, which adds it to its history; then the
backoff weights of their words.  A block asks for a word or pair once, so no range has a hot key, and
nothing that grows with the texts is broadcast.  ``evaluate`` learns from some texts of a table and scores
them all by the same questions; ``fit`` stores the tables of a model, by which ``score`` scores other texts.

Cases: null or empty text - the end token alone; no training text - every word unseen; very long texts -
whole; repeated rows - scored alike; null ids - carried; empty table - empty result; other columns -
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import ODD, ByteWords, mixed, steps, stored, text_bytes

TOP = 5
# discounts are kept to 16 binary places, so sums of discounted counts are exact whole units
UNITS = 1 << 16
# tokens of one block's worth of texts, and words or pairs of one bucket
BLOCK_TOKENS, BUCKET_PAIRS = 600_000, 4_000_000
MOST_TEXTS = 60_000
# a pair is told apart by the upper 56 bits of its hash
PAIR_BITS = np.uint64((1 << 64) - (1 << 8))
START, END = np.uint64(0x57A2757A2757A275), np.uint64(0x0E0D0E0D0E0D0E0D)


# -- packing --------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    body = pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)
    return bytes([width]) + len(values).to_bytes(4, "little") + body


def unpack(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:5], "little")
    if not n:
        return np.zeros(0, np.int64)
    plain = pa.Codec("zstd").decompress(packed[5:], decompressed_size=n * width, asbytes=True)
    planes = np.frombuffer(plain, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def pack_sorted(hashes: np.ndarray) -> bytes:
    gaps = hashes.copy()
    gaps[1:] -= hashes[:-1]
    return pack(gaps)


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed).view(np.uint64), dtype=np.uint64)


def pack_floats(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, np.float64).view(np.uint64))


def unpack_floats(packed: bytes) -> np.ndarray:
    return unpack(packed).view(np.float64)


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of sorted hashes; a bucket is a range of hashes."""
    cuts = np.searchsorted(hashes, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)).tolist() + [len(hashes)]
    return ((b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a)



# -- tokens ---------------------------------------------------------------------------------


def token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, token hashes with an end after each text, first token of each text and the end)."""
    find = ByteWords()
    for batch in batches:
        for at, to, data, offsets in steps(batch.column("body")):
            words, first, _, _ = find(data, offsets)
            out = np.insert(words, first[1:], END)
            yield batch.slice(at, to - at), out, first + np.arange(len(first))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Token runs joined to blocks of some million tokens."""
    rows, words, firsts, n, texts = [], [], [], 0, 0
    for batch, own, first in token_runs(batches):
        if rows and (n + len(own) > BLOCK_TOKENS or texts + batch.num_rows > MOST_TEXTS):
            yield rows, np.concatenate(words), np.r_[np.concatenate(firsts), n]
            rows, words, firsts, n, texts = [], [], [], 0, 0
        rows.append(batch)
        words.append(own)
        firsts.append(first[:-1] + n)
        n += len(own)
        texts += batch.num_rows
    if rows:
        yield rows, np.concatenate(words), np.r_[np.concatenate(firsts), n]


def discounts(n: list[float], least: int) -> np.ndarray:
    """Factor for each count up to TOP from counts of counts n[1..TOP + 1]; index 0 is unused."""
    d = np.ones(TOP + 1)
    if n[1] > 0 and all(x > 0 for x in n[1:]):
        a = (TOP + 1) * n[TOP + 1] / n[1]
        for r in range(1, TOP + 1):
            d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) if a < 1 else -1
    # where the counts of counts are too few to tell, half a count is taken off
    for r in range(1, TOP + 1):
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    d = np.maximum(np.round(d * UNITS), 1) / UNITS
    d[:least] = 0.0
    return d


PACKED = ("words", "lengths", "often", "tokens")
HELD = ("block", "rows", *PACKED)

# -- blocks ---------------------------------------------------------------------------------


def _blocks(docs: DataFrame, text: str, keep: tuple[str, ...] = (), learn=None) -> DataFrame:
    """block, rows (the ``keep`` columns), n_tokens (to learn from), words (dictionary), times (that they are
    learned from), lengths, learned (a mark for each text), often (uses of each word), tokens; stored.  Without ``learn`` all texts are.
    """
    learn = F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)).alias("learn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, tokens, first in gathered(batches):
            kept = pa.Table.from_batches([b.select(list(keep)) for b in held]) if keep else pa.table({})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as writer:
                writer.write_table(kept)
            words, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
            learned = np.concatenate([np.asarray(b.column("learn").cast(pa.int8())) for b in held])
            counted = at[np.repeat(learned > 0, np.diff(first))]
            times = np.bincount(counted, minlength=len(words))
            # frequent words get small numbers, which pack best
            number = np.empty_like(at, shape=len(words))
            number[_by_use(often)] = np.arange(len(words))
            packed = (pack_sorted(words), pack(times), pack(np.diff(first)), pack(learned), pack(often), pack(number[at]))
            values = (sink.getvalue().to_pybytes(), len(counted), *packed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, (pa.binary(), pa.int64(), *[pa.binary()] * 6))],
                names=["rows", "n_tokens", "words", "times", "lengths", "learned", "often", "tokens"],
            )

    names = [F.col(c) for c in keep]
    blocks = docs.select(*names, text_bytes(text).alias("body"), learn).mapInArrow(
        run, "rows binary, n_tokens long, words binary, times binary, lengths binary, learned binary, often binary, tokens binary"
    )
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _pairs(words: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each token's history in the dictionary, its length for a start; hash of each pair)."""
    history = np.empty_like(tokens)
    history[1:] = tokens[:-1]
    history[first[:-1]] = len(words)
    return history, mixed(np.r_[words, START][history] * np.uint64(ODD) + words[tokens]) & PAIR_BITS


def _by_use(often: np.ndarray) -> np.ndarray:
    """Places of words from the most used on."""
    return np.argsort(-often, kind="stable")


def _opened(words: bytes, lengths: bytes, often: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, first token of each text and the end, place of each token in the dictionary)."""
    return unpack_sorted(words), np.r_[0, np.cumsum(unpack(lengths))], _by_use(unpack(often))[unpack(tokens)]


def _ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """ask_bucket, block, asked, times: a block's dictionary and the start, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, times, learned in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "times", "learned"))):
                words, times = unpack_sorted(words), unpack(times)
                place = int(np.searchsorted(words, START))
                words, times = np.insert(words, place, START), np.insert(times, place, int(unpack(learned).sum()))
                yield _asked(block, words, times, buckets)

    return blocks.select("block", "words", "times", "learned").mapInArrow(run, "ask_bucket int, block long, asked binary, times binary")


def _ask_pairs(blocks: DataFrame, buckets: int) -> DataFrame:
    """ask_bucket, block, asked, times: a block's distinct pairs, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, learned, *packed in zip(*(batch.column(c).to_pylist() for c in ("block", "learned", *PACKED))):
                words, first, tokens = _opened(*packed)
                pairs, at = np.unique(_pairs(words, tokens, first)[1], return_inverse=True)
                times = np.bincount(at[np.repeat(unpack(learned) > 0, np.diff(first))], minlength=len(pairs))
                yield _asked(block, pairs, times, buckets)

    return blocks.select("block", "learned", *PACKED).mapInArrow(run, "ask_bucket int, block long, asked binary, times binary")


def _asked(block: int, hashes: np.ndarray, times: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows = [(b, block, pack_sorted(hashes[a:z]), pack(times[a:z])) for b, a, z in by_bucket(hashes, buckets)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
        names=["ask_bucket", "block", "asked", "times"],
    )


def _counted(asked: DataFrame, name: str, tell_places: bool) -> tuple[DataFrame, DataFrame, list[int]]:
    """(bucket, hashes, counts), (block, bucket, counts in the order asked), counts of counts.

    The counts of counts have, at r up to TOP + 1, how many hashes have count r; then all hashes, all counts.
    Counts are answered doubled, with one more in one of the blocks that asked.  What was asked for but
    never learned from is answered 0 and not kept.  With ``tell_places`` answers also have the places of
    the hashes among those kept.
    """

    def add(key: tuple, table: pa.Table) -> pa.Table:
        # a bucket is the largest thing in a task: places are 32 bits, answers are made block by block
        blocks, asked = table["block"].to_pylist(), table["asked"]
        hashes = np.concatenate([unpack_sorted(x.as_py()) for x in asked])
        times = np.concatenate([unpack(x.as_py()).astype(np.int32) for x in table["times"]])
        cuts = np.cumsum([0] + [int.from_bytes(x.as_py()[1:5], "little") for x in asked])
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes = hashes[order]
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        heads = np.flatnonzero(new)
        hashes, counts = hashes[heads], np.add.reduceat(times[order], heads, dtype=np.int64)
        del times
        kind = np.empty(len(order), np.int32)
        kind[order] = np.cumsum(new, dtype=np.int32) - 1
        marked = np.zeros(len(order), bool)
        marked[order[heads]] = counts > 0
        del order, new, heads
        kept_at = np.maximum(np.cumsum(counts > 0) - 1, 0).astype(np.uint64)
        own, known = hashes[counts > 0], counts[counts > 0]
        del hashes
        real = known[own != START]
        sizes = [int((real == r).sum()) for r in range(TOP + 2)] + [len(real), int(real.sum())]
        rows = [(None, pack_sorted(own), pack(known), sizes, None)]
        for block, a, z in zip(blocks, cuts[:-1], cuts[1:]):
            at = kind[a:z]
            rows.append((block, None, pack(2 * counts[at] + marked[a:z]), None, pack_sorted(kept_at[at]) if tell_places else None))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(rows), pa.int32())} | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("block", "hashes", "counts", "sizes", "places"), kinds))})

    both = stored(asked.groupBy("ask_bucket").applyInArrow(add, "bucket int, block long, hashes binary, counts binary, sizes array<bigint>, places binary"), name)
    found = both.where("sizes is not null").select(F.posexplode("sizes").alias("r", "k")).groupBy("r").agg(F.sum("k").alias("k")).collect()
    sizes = {r["r"]: r["k"] for r in found}
    return (
        both.where("block is null").select("bucket", "hashes", "counts"),
        both.where("block is not null").select("block", "bucket", "counts", "places"),
        [sizes.get(r, 0) for r in range(TOP + 4)],
    )


# -- training -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    pair_discount: np.ndarray
    word_discount: np.ndarray
    word_scale: float
    unseen: float  # log10 P of a word never seen
    total: int
    distinct: int

    def word_log(self, count: np.ndarray) -> np.ndarray:
        """log10 P of words by their training count."""
        d = np.where(count <= TOP, self.word_discount[np.minimum(count, TOP)], 1.0)
        with np.errstate(divide="ignore"):
            seen = np.log10(d * count * self.word_scale / max(1, self.total))
        return np.where(count > 0, seen, self.unseen)

    def base_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def low_units(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts of words in units; P(w) is their share of ``units_of_one``."""
        return count * np.where(count <= TOP, self.word_discount[np.minimum(count, TOP)], 1.0) * UNITS

    @property
    def units_of_one(self) -> float:
        return max(1, self.total) * UNITS / self.word_scale

    def discounted(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts of pairs."""
        return count * np.where(count <= TOP, self.pair_discount[np.minimum(count, TOP)], 1.0)


@dataclass(frozen=True)
class Trained:
    model: Model
    words: DataFrame  # bucket, hashes, counts, back (log10 a(h)), shrink (log10 of what pairs of h shrink by)
    pairs: DataFrame  # bucket, hashes, counts
    word_buckets: int
    pair_buckets: int


def _in_row(answers: pa.Table, kind: int, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *map(unpack, _in_order(answers, kind, column))])


def _in_order(answers: pa.Table, kind: int, column: str) -> list[bytes]:
    """A block's packed answers of one kind, by bucket and so in the order of hashes."""
    rows = zip(*(answers[c].to_pylist() for c in ("kind", "bucket", column)))
    return [x for _, x in sorted((b, x) for k, b, x in rows if k == kind)]


def _answers(of: DataFrame, kind: int) -> DataFrame:
    """Packed answers with their kind and the columns that other kinds have."""
    none = F.lit(None).cast("binary")
    more = [F.col(c) if c in of.columns else none.alias(c) for c in ("counts", "places", "back", "shrink")]
    return of.select("block", "bucket", *more, F.lit(kind).alias("kind"))


@dataclass(frozen=True)
class Learned:
    """A model and how its tables come from blocks and their answers."""

    model: Model
    blocks: DataFrame
    words: DataFrame  # bucket, hashes, counts
    pairs: DataFrame  # bucket, hashes, counts
    word_answers: DataFrame
    pair_answers: DataFrame
    buckets: int

    def sums(self) -> DataFrame:
        """block, of_bucket, places, a, b, unmet: per learned history of a block (by its place in its bucket), in
        units, the discounted count and the lower-order mass of those seen pairs that are marked there, and
        whether it stands before an unseen word."""
        model = self.model

        def run(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
            hashes, first, own = _opened(*(block[c][0].as_py() for c in PACKED))
            place = np.searchsorted(hashes, START)
            asked = _in_row(answers, 0, "counts") >> 1
            count = np.delete(asked, place)
            history, code = _pairs(hashes, own, first)
            at = np.unique(code, return_index=True)[1]
            seen = _in_row(answers, 1, "counts")
            # the start goes where its hash stands
            turn = np.insert(np.arange(len(hashes)), place, len(hashes))
            unmet = np.bincount(history[at[seen == 0]], minlength=len(turn))[turn] > 0
            at, seen = at[seen & 1 > 0], seen[seen & 1 > 0] >> 1
            h, w = history[at], own[at]
            a = np.bincount(h, model.discounted(seen) * UNITS, len(turn))[turn].astype(np.int64)
            b = np.bincount(h, model.low_units(count[w]), len(turn))[turn].astype(np.int64)
            rows, i = [], 0
            for bucket, places in sorted((n, x) for k, n, x in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "places"))) if k == 0):
                places = unpack_sorted(places)
                part, i = slice(i, i + len(places)), i + len(places)
                known = asked[part] > 0
                rows.append((bucket, pack_sorted(places[known]), *(pack(x[part][known]) for x in (a, b, unmet))))
            names = (("of_bucket", pa.int32()), ("places", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("unmet", pa.binary()))
            own_block = {"block": pa.array([key[0].as_py()] * len(rows), pa.int64())}
            return pa.table(own_block | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(names)})

        answers = _answers(self.word_answers, 0).unionByName(_answers(self.pair_answers, 1)).select("block", "bucket", "kind", "counts", "places")
        held = self.blocks.select(*HELD).groupBy("block").cogroup(answers.groupBy("block"))
        return held.applyInArrow(run, "block long, of_bucket int, places binary, a binary, b binary, unmet binary")

    def weights(self, answer: bool) -> DataFrame:
        """bucket, hashes, counts, back (log10 a(h)), shrink (log10 of what pairs of h shrink by); with
        ``answer`` block, bucket, back (0 where no unseen word follows) and shrink in the order of ``sums``."""
        model = self.model

        def run(key: tuple, table: pa.Table, parts: pa.Table) -> pa.Table:
            count = unpack(table["counts"][0].as_py())
            a, b, asked = np.zeros(len(count), np.int64), np.zeros(len(count), np.int64), []
            for places, x, y, unmet in zip(*(parts[c].to_pylist() for c in ("places", "a", "b", "unmet"))) if parts.num_rows else ():
                at = unpack_sorted(places).astype(np.int64)
                a[at] += unpack(x)
                b[at] += unpack(y)
                asked.append((at, unpack(unmet) > 0))
            share_of = a / UNITS / count
            # some mass stays for unseen words even where no seen pair is discounted
            shrink = np.minimum(1.0, (1 - 0.5 / (count + 1)) / np.where(share_of > 0, share_of, 1e-9))
            back, shrink = np.log10((1 - share_of * shrink) / (1 - b / model.units_of_one)), np.log10(shrink)
            if not answer:
                return pa.table({"bucket": table["bucket"], "hashes": table["hashes"], "counts": table["counts"], "back": pa.array([pack_floats(back)], pa.binary()), "shrink": pa.array([pack_floats(shrink)], pa.binary())})
            packed = {
                "back": pa.array([pack_floats(np.where(unmet, back[at], 0.0)) for at, unmet in asked], pa.binary()),
                "shrink": pa.array([pack_floats(shrink[at]) for at, _ in asked], pa.binary()),
            }
            own_bucket = pa.array([key[0].as_py()] * len(asked), pa.int32())
            return pa.table({"block": parts["block"] if asked else pa.array([], pa.int64()), "bucket": own_bucket} | packed)

        schema = "block long, bucket int, back binary, shrink binary" if answer else "bucket int, hashes binary, counts binary, back binary, shrink binary"
        return self.words.groupBy("bucket").cogroup(self.sums().groupBy("of_bucket")).applyInArrow(run, schema)


def _learn(blocks: DataFrame) -> Learned:
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-tokens // BUCKET_PAIRS))
    words, word_answers, sizes = _counted(_ask_words(blocks, buckets), "words", True)
    distinct, total = sizes[TOP + 2 :]
    word_discount = discounts([0.0] + [float(x) for x in sizes[1 : TOP + 2]], 1)
    mass = (total - sum(r * sizes[r] * (1 - word_discount[r]) for r in range(1, TOP + 1))) / max(1, total)
    scale = min(1.0, (1 - 0.5 / (total + 1)) / mass) if mass else 1.0
    unseen = float(np.log10(1 - mass * scale))
    pairs, pair_answers, sizes = _counted(_ask_pairs(blocks, buckets), "pairs", False)
    pair_discount = discounts([0.0] + [float(x) for x in sizes[1 : TOP + 2]], 1)
    model = Model(pair_discount, word_discount, scale, unseen, total, distinct)
    return Learned(model, blocks, words, pairs, word_answers, pair_answers, buckets)


def fit(docs: DataFrame, text: str = "text") -> Trained:
    """The model of all texts of ``docs``, in stored tables."""
    learned = _learn(_blocks(docs, text))
    return Trained(learned.model, stored(learned.weights(False), "weights"), learned.pairs, learned.buckets, learned.buckets)


def evaluate(docs: DataFrame, learn, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The scores of all texts of ``docs`` by the model of those that satisfy ``learn`` (a condition)."""
    learned = _learn(_blocks(docs, text, (key, *carry), learn))
    counts = _answers(learned.word_answers, 0).unionByName(_answers(learned.pair_answers, 1))
    answers = counts.unionByName(_answers(learned.weights(True), 2))
    return _settled(docs, learned.model, learned.blocks, answers, (key, *carry), doubled=True)


# -- scoring --------------------------------------------------------------------------------


def score(docs: DataFrame, trained: Trained, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every text."""
    model, keep = trained.model, (key, *carry)
    blocks = _blocks(docs, text, keep)

    def answer(columns: tuple[str, ...]):
        """What a bucket has of the hashes asked for, zeros for those it lacks."""

        def run(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
            hashes, values = np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * len(columns)
            if table.num_rows and asked.num_rows:
                hashes = unpack_sorted(table["hashes"][0].as_py())
                values = [unpack(table[c][0].as_py()) for c in columns]
            out = []
            for x in asked["asked"].to_pylist():
                own = unpack_sorted(x)
                at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                seen = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
                rows = []
                for v in values:
                    found = np.zeros(len(own), np.int64)
                    found[seen] = v[at[seen]]
                    rows.append(pack(found.view(np.uint64)))
                out.append(rows)
            return pa.table({"block": asked["block"], "bucket": asked["ask_bucket"]} | {c: pa.array([r[k] for r in out], pa.binary()) for k, c in enumerate(columns)})

        return run

    of_words = trained.words.groupBy("bucket").cogroup(_ask_words(blocks, trained.word_buckets).drop("times").groupBy("ask_bucket"))
    of_words = of_words.applyInArrow(answer(("counts", "back", "shrink")), "block long, bucket int, counts binary, back binary, shrink binary")
    of_pairs = trained.pairs.groupBy("bucket").cogroup(_ask_pairs(blocks, trained.pair_buckets).drop("times").groupBy("ask_bucket"))
    of_pairs = of_pairs.applyInArrow(answer(("counts",)), "block long, bucket int, counts binary")

    return _settled(docs, model, blocks, _answers(of_words, 0).unionByName(_answers(of_pairs, 1)), keep, doubled=False)


def _settled(docs: DataFrame, model: Model, blocks: DataFrame, answers: DataFrame, keep: tuple[str, ...], doubled: bool) -> DataFrame:
    """Scores of the texts in ``blocks`` from the answers to them: counts of words (kind 0, with the backoff
    weights, unless these come as kind 2) and counts of pairs (kind 1), which may be ``doubled``."""
    weights = 2 if doubled else 0

    def settle(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(block["rows"][0].as_py()).read_all()
        hashes, first, own = _opened(*(block[c][0].as_py() for c in PACKED))
        place = np.searchsorted(hashes, START)
        # the start goes last, where histories look for it
        turn = np.r_[np.delete(np.arange(len(hashes) + 1), place), place]
        count, pair = _in_row(answers, 0, "counts") >> doubled, _in_row(answers, 1, "counts") >> doubled
        back, shrink = (np.concatenate([unpack_floats(x) for x in _in_order(answers, weights, c)]) for c in ("back", "shrink"))
        if doubled:
            # these are of learned words alone; the others' are 0
            filled = np.zeros((2, len(count)))
            filled[:, count > 0] = back, shrink
            back, shrink = filled
        count, back, shrink = count[turn], back[turn], shrink[turn]
        history, code = _pairs(hashes, own, first)
        pair = pair[np.unique(code, return_inverse=True)[1]]
        value = back[history] + model.word_log(count)[own]
        seen = np.flatnonzero(pair)
        h = history[seen]
        value[seen] = np.log10(model.discounted(pair[seen])) + shrink[h] - np.log10(count[h])
        begin = first[:-1]
        known, base = (count > 0).astype(np.int64)[own], model.base_log(count)[own]
        out = {c: rows[c] for c in keep} | {"n_tokens": pa.array(np.diff(first)), "n_known": pa.array(np.add.reduceat(known, begin))}
        return pa.table(out | {"train_tokens": pa.array(np.full(len(begin), model.total, np.int64)), "base_score": pa.array(np.add.reduceat(base, begin)), "score": pa.array(np.add.reduceat(value, begin))})

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select(*HELD).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, schema)

"""N-gram Jaccard self-join of documents by a token-group matrix.

A document's set holds its distinct shingles.  Documents with equal sets form a class, and classes are
what is joined: two link when ``100 * |A and B| >= 80 * |A or B|``.

1. Every set is put in one global order, rare shingles first.  Of two linked sets of sizes a and b, the
   overlap is at least ``0.8 / 1.8 * (a + b)``; what their prefixes (the first ``PREFIX`` percent) share,
   plus the longer of the two rests, bounds it from above.
2. A class is out once it shares too few prefix shingles with all others together, which is counted
   again until hardly any class goes.
3. Classes with the same minimum under one of ``KEYS`` orders form a group, dealt by a hash to parts of
   about ``PART`` members.  The members of a part are compared in one task, but not once they are linked.
   Other orders deal them to other parts, so that a large group of near copies becomes one, until an order
   links hardly any.
4. Groups of linked classes give the matrix: a row (shingle, group) for each prefix shingle of a group's
   union.  With each class's prefix in one order, shingles of few groups first, the first shingle two linked
   sets share has at least as many behind it, in either, as their sizes demand.  So a shingle brings query
   and group together only for the sizes this leaves; of shingles of many groups, only rows of such sizes meet.
5. What is left has to differ in few parity bits of its sets, too.  Counting a query's rows of a group bounds its overlap with every member; groups that reach what the sizes
   demand are bounded again by the unions of their parts, and what is left is opened, only where group and
   query are not linked yet, and compared first with the whole union, then member by member.
6. Links join to components by alternating star contraction.

The frequent shingles that go last in the order are counted over all texts; which of them are listed
changes the work, never the result.

Cases: null, empty or blank text - empty set, its own component; fewer than five words - the whole
sequence as one shingle; null id - its component is the smallest id it reaches, null if none; repeated
rows and equal ids - each row is returned; empty table - empty result; other columns - ignored by
``components`` and passed by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import SHORT_STEP, ByteWords, free_name, mixed, share, steps, stored, text_bytes

SHINGLE = 5
PERCENT = 80
PREFIX = 30
KEYS = 5
PART = 128
# an order that links at most one class in so many is the last one tried
SETTLED = 100
FREQUENT = 1 << 16
# classes whose sets are wanted: as many are sent to the tasks as a list, beyond that they are joined
LISTED = 2_000_000
# queries that one task compares with an opened group
QUERIES = 256
# shingles of more groups than this meet by ranges of sizes, each so many times the one before
FEW = 16
RANGE = 1.05
# 64-bit words of a set's parity bits
WORDS = 32


# -- sets -----------------------------------------------------------------------------------


def shingle_sets(find: ByteWords, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first, _, _ = find(data, offsets)
    odd = np.uint64(0x9E3779B97F4A7C15)
    n = len(words)
    rolled = words.copy()
    for k in range(1, SHINGLE):
        rolled = rolled * odd
        rolled[: n - k] += words[k:]
        rolled ^= rolled >> np.uint64(29)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            whole = xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(words[:0])
    return out


def prefix_size(n: int) -> int:
    """At least as many members as can't all be missing from a linked set."""
    return max(n - -(-PERCENT * n // 100) + 1, -(-PREFIX * n // 100))


def _rest(n: Column) -> Column:
    """Members beyond the prefix."""
    return n - F.greatest(n - F.ceil(n * PERCENT / 100) + 1, F.ceil(n * PREFIX / 100))


def _demanded(n: Column, m: Column) -> Column:
    """Prefix shingles that linked sets of these sizes share at least."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT) - 1e-6) - F.greatest(_rest(n), _rest(m)) - 1


def _reached() -> Column:
    """Whether the ``c`` prefix shingles that a set of size n shares with a union suffice for a link with
    a set of size lo to hi."""
    n = F.col("n")
    lo, hi = F.greatest("lo", F.ceil(n * PERCENT / 100)), F.least("hi", F.floor(n * 100 / PERCENT))
    return (lo <= hi) & (F.col("c") >= F.least(_demanded(n, lo), _demanded(n, hi)))


def _minima(own: np.ndarray) -> list[int]:
    """The smallest member under each of the orders."""
    return [int(mixed(own ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min().view(np.int64)) for k in range(KEYS)]


def sign(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def parity(own: np.ndarray) -> np.ndarray:
    """Bits that say for each remainder whether an odd number of members has it: sets differ by as many
    members at least as their bits do."""
    odd = np.bincount((own % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _apart(a: str, b: str) -> Column:
    """The number of parity bits in which two columns of them differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def _frequent(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that most often occur in several texts close to each other, most frequent ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = ByteWords(step=SHORT_STEP)
        for batch in batches:
            for _, _, data, offsets in steps(batch.column("body"), SHORT_STEP):
                own = {sign(s): s for s in shingle_sets(find, data, offsets) if len(s)}
                if own:
                    token, n = np.unique(np.concatenate(list(own.values())), return_counts=True)
                    many = n > 1
                    yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], names=["token", "n"])

    counted = docs.select(text_bytes(text).alias("body")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 8").orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(top["token"].to_numpy().view(np.uint64))


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sig, minima): minima are the group keys, given once per task for equal sets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = ByteWords(step=SHORT_STEP), set()
        for batch in batches:
            for at, to, data, offsets in steps(batch.column("_body"), SHORT_STEP):
                n, sig, keys = [], [], []
                for own in shingle_sets(find, data, offsets):
                    n.append(len(own))
                    sig.append(sign(own) if len(own) else None)
                    fresh = sig[-1] is not None and sig[-1] not in seen
                    keys.append(_minima(own) if fresh else None)
                    if fresh:
                        seen.add(sig[-1])
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(at, to - at), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=[key, "n", "sig", "minima"],
                )

    return docs.select(key, text_bytes(text).alias("_body")).mapInArrow(run, f"`{key}` {kind}, n long, sig binary, minima array<bigint>")


def _prefixes(docs: DataFrame, text: str, frequent: np.ndarray) -> DataFrame:
    """(token, h, common): prefix shingles, h a hash of the set's signature; equal sets once per task.

    Those of ``frequent`` are common: they are known to be in several sets.
    """
    shared = share(docs.sparkSession, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, frequent, seen = ByteWords(step=SHORT_STEP), shared(), set()
        for batch in batches:
            for _, _, data, offsets in steps(batch.column("body"), SHORT_STEP):
                held, names, known = [], [], []
                for own in shingle_sets(find, data, offsets):
                    if not len(own) or (name := sign(own)) in seen:
                        continue
                    seen.add(name)
                    size = prefix_size(len(own))
                    prefix, rare = own[:size], size
                    if len(frequent):
                        common = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                        prefix = own[~common][:size]
                        if (rare := len(prefix)) < size:
                            prefix = np.concatenate([prefix, own[common][: size - len(prefix)]])
                    held.append(prefix)
                    known.append(np.arange(len(prefix)) >= rare)
                    names.append(int.from_bytes(name[:8], "big", signed=True))
                if len(seen) > 1_000_000:
                    seen.clear()
                if held:
                    h = np.repeat(np.array(names, np.int64), [len(x) for x in held])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(h), pa.array(np.concatenate(known))], names=["token", "h", "common"])

    return docs.select(text_bytes(text).alias("body")).mapInArrow(run, "token long, h long, common boolean")


def _several(rows: DataFrame) -> DataFrame:
    """Distinct (token, h) of tokens with several h, and those that are common anyway, of (token, h, common).

    Rows meet by token; common tokens, which may be in very many sets, are dealt by their sets too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next one
        token, h, stays = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for batch in batches:
            token = np.concatenate([token, batch.column("token").to_numpy()])
            h = np.concatenate([h, batch.column("h").to_numpy()])
            stays = np.concatenate([stays, batch.column("common").to_numpy(zero_copy_only=False)])
            if not len(token):
                continue
            equal = token[1:] == token[:-1]
            fresh = np.concatenate([[True], ~equal | (h[1:] != h[:-1])])
            token, h, stays = token[fresh], h[fresh], stays[fresh]
            equal = token[1:] == token[:-1]
            stays[1:] |= equal
            stays[:-1] |= equal
            kept = np.flatnonzero(stays[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(token[kept]), pa.array(h[kept])], names=["token", "h"])
            token, h, stays = token[-1:], h[-1:], stays[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(token[stays]), pa.array(h[stays])], names=["token", "h"])

    place = F.when(F.col("common"), F.xxhash64("token", "h")).otherwise(F.col("token"))
    return rows.repartition(place).sortWithinPartitions("token", "h").mapInArrow(run, "token long, h long")


def _short_hash(sig: str) -> Column:
    """The first eight bytes of a signature, as in ``_prefixes``."""
    return F.conv(F.hex(F.substring(F.col(sig), 1, 8)), 16, -10).cast("bigint")


def _full_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(cls, members, bits) for the classes of ``wanted`` (cls, sig); members is packed and sorted."""
    names = None
    if wanted.count() <= LISTED:
        names = np.sort(wanted.select(_short_hash("sig").alias("h")).toArrow()["h"].to_numpy())
    shared = share(docs.sparkSession, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, names = ByteWords(step=SHORT_STEP), set(), shared()
        for batch in batches:
            for _, _, data, offsets in steps(batch.column("body"), SHORT_STEP):
                rows = []
                for own in shingle_sets(find, data, offsets):
                    if len(own) and (name := sign(own)) not in seen:
                        seen.add(name)
                        if names is None or _listed(names, name):
                            rows.append((name, own.tobytes(), parity(own)))
                if len(seen) > 1_000_000:
                    seen.clear()
                if rows:
                    sig, members, bits = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sig, pa.binary()), pa.array(members, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["sig", "members", "bits"]
                    )

    made = docs.select(text_bytes(text).alias("body")).mapInArrow(run, "sig binary, members binary, bits array<bigint>")
    return made.join(wanted, "sig").dropDuplicates(["cls"]).select("cls", "members", "bits")


def _listed(names: np.ndarray, sig: bytes) -> bool:
    """Whether a signature's first eight bytes are in the sorted list."""
    own = int.from_bytes(sig[:8], "big", signed=True)
    at = int(np.searchsorted(names, own))
    return at < len(names) and int(names[at]) == own


# -- comparing inside tasks -----------------------------------------------------------------


class _Union:
    """Members that are linked, by the smallest one."""

    def __init__(self) -> None:
        self.up: dict = {}

    def top(self, x):
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def join(self, a, b) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    a, b = (a, b) if len(a) < len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _within(key: tuple, members: pa.Table) -> pa.Table:
    """(a, b) labels of the members of one part that are linked to those of a smaller label."""
    label = members["label"].to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in members["members"].to_pylist()]
    order = sorted(range(len(label)), key=lambda i: (len(sets[i]), label[i]))
    joined = _Union()
    for x, i in enumerate(order):
        for j in reversed(order[:x]):
            if 100 * len(sets[j]) < PERCENT * len(sets[i]):
                break
            if joined.top(label[i]) != joined.top(label[j]) and linked(_common(sets[i], sets[j]), len(sets[i]), len(sets[j])):
                joined.join(label[i], label[j])
    pairs = [(c, joined.top(c)) for c in set(label) if joined.top(c) != c]
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _opened(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
    """(a, b) labels of queries and of the members of an opened group that are linked."""
    sets = [np.frombuffer(x, np.uint64) for x in members["members"].to_pylist()]
    union = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    found = set()
    label = members["label"][0].as_py() if len(sets) else None
    for own, mine in zip(queries["query"].to_pylist(), queries["q_label"].to_pylist()):
        query = np.frombuffer(own, np.uint64)
        # the bound by the group's whole union; all members share one label, so one link is enough
        if not len(union) or 100 * _common(query, union) < PERCENT * len(query):
            continue
        if any(linked(_common(query, s), len(query), len(s)) for s in sets):
            found.add((mine, label))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


# -- components -----------------------------------------------------------------------------


def contract(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b)."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours move to the smallest
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        again = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = stored(again.where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct ``edges`` (a, b) with a > b has one smaller neighbour, which has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count() == 0


# -- the join -------------------------------------------------------------------------------


def _settle_groups(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, label) after the links inside parts of groups of equal minima, for classes that have one.

    Every order deals the members of a group to other parts, so that what is linked in a large group
    comes together although each member meets few others.  After an order members take the smallest label
    they met, and sets move only to parts that hold more than one label.  After an order with few links the
    rest is left to the matrix, which finds every link.
    """
    few = classes.count() // SETTLED
    now, edges = classes.select("cls", "minima", F.col("cls").alias("label")), None
    for k in range(KEYS):
        own = now.select("cls", "label", F.col("minima")[k].alias("key"))
        sizes = own.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        parts = own.join(sizes.select("key", "n"), "key").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(k)), F.ceil(F.col("n") / PART)))
        differ = parts.groupBy("key", "part").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key", "part")
        open_parts = stored(parts.select("cls", "label", "key", "part").join(differ, ["key", "part"]), "parts")
        found = stored(open_parts.join(sets.select("cls", "members"), "cls").groupBy("key", "part").applyInArrow(_within, "a long, b long"), "linked")
        edges = found if edges is None else edges.unionByName(found)
        if k + 1 == KEYS or found.count() <= few:
            break
        least = found.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("b"))
        now = stored(now.join(least, "label", "left").select("cls", "minima", F.coalesce("b", "label").alias("label")), "labels")
    return contract(edges).select(F.col("node").alias("cls"), F.col("root").alias("label"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Of (token, cls, n): without classes that share too few shingles with all others together."""
    n = F.col("n")
    need = F.least(_demanded(n, F.ceil(n * PERCENT / 100)), _demanded(n, F.floor(n * 100 / PERCENT)))
    before = rows.count()
    while before:
        kept = rows.groupBy("cls", "n").agg(F.count("*").alias("c")).where(F.col("c") >= need).select("cls")
        rows = rows.join(stored(kept, "kept"), "cls", "left_semi")
        several = rows.groupBy("token").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("token")
        rows = stored(rows.join(several, "token", "left_semi"), "rows")
        after = rows.count()
        if after > 0.95 * before:
            break
        before = after
    return rows


def _range(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(RANGE)).cast("int")


def _near(asked: DataFrame) -> DataFrame:
    """(cls, n, label, other): classes and the other labels that may hold a set of equal or larger size linked
    to theirs, of (token, cls, n, label, often, behind).

    ``behind`` counts a class's rows from this one on, in an order common to all classes.  The first shingle
    of two linked sets of sizes n <= m has at least ``share * (n + m) - rest * m`` of them, in either set.
    """
    n, behind, share, rest = F.col("n"), F.col("behind"), PERCENT / (100 + PERCENT), 1 - PREFIX / 100
    few = F.col("often") <= FEW

    def ranges(a: str, b: str) -> Column:
        return F.explode(F.when(few, F.array(F.lit(-1))).otherwise(F.sequence(_range(F.col(a)), _range(F.col(b)))))

    own = F.when(few, F.lit(-1)).otherwise(_range(n))
    least = F.greatest(n, F.ceil((share * n - behind) / (rest - share) - 1e-6)).alias("least")
    asks = asked.select("token", "cls", "n", "label", "often", least, F.floor(n * 100 / PERCENT).alias("most")).where("least <= most")
    asks = asks.select("token", "cls", "n", "label", "least", own.alias("n_range"), ranges("least", "most").alias("m_range"))
    below = F.least(n, F.floor((behind + (rest - share) * n) / share + 1e-6)).alias("below")
    held = asked.select("token", F.col("label").alias("other"), "n", "often", F.ceil(n * PERCENT / 100).alias("above"), below).where("above <= below")
    held = held.select("token", "other", F.col("n").alias("m"), "below", own.alias("m_range"), ranges("above", "below").alias("n_range"))
    held = held.groupBy("token", "n_range", "m_range", "other").agg(F.max("m").alias("m"), F.max("below").alias("below"))
    met = asks.join(held, ["token", "n_range", "m_range"]).where("label <> other and least <= m and n <= below")
    return met.select("cls", "n", "label", "other").distinct()


def _alike(near: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``near`` (cls, n, label, other) whose parity bits allow a link, with the span of the other label.

    Linked sets of sizes n and m differ by at most a ninth of n + m members, so by no more bits.  A label's
    members differ by at most ``radius`` bits from its first class, which is named like the label.
    """
    bits = sets.select("cls", "bits")
    first = bits.select(F.col("cls").alias("other"), F.col("bits").alias("other_bits"))
    inside = labels.where("cls <> label").select("cls", F.col("label").alias("other")).join(bits, "cls").join(first, "other")
    wide = inside.groupBy("other").agg(F.max(_apart("bits", "other_bits")).alias("radius"))
    spans = labels.groupBy(F.col("label").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), (F.min("gid") < F.max("gid")).alias("several"), F.min("gid").alias("only"))
    wide = spans.join(wide, "other", "left").fillna(0, ["radius"])
    n = F.col("n")
    most = F.floor((n + F.least("hi", F.floor(n * 100 / PERCENT))) * (100 - PERCENT) / (100 + PERCENT) + 1e-6)
    met = near.join(wide, "other").join(bits, "cls").join(first, "other")
    return met.where(_apart("bits", "other_bits") <= most + F.col("radius")).select("cls", "n", "label", "other", "lo", "hi", "several", "only")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    signed = stored(_signed(docs, key, text), "signed")
    grouped = signed.where("sig is not null").groupBy("sig").agg(F.min(key).alias("id"), F.max("n").alias("n"), F.max("minima").alias("minima"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("cls"), "sig", "id", "n", "minima"), "classes")

    # prefix shingles of more than one class, then of classes that may have a link at all
    rows = _several(_prefixes(docs, text, _frequent(docs, text)))
    named = classes.select(_short_hash("sig").alias("h"), "cls", "n")
    shared = _candidates(stored(rows.join(named, "h").select("token", "cls", "n"), "rows"))

    likely = stored(classes.join(shared.select("cls").distinct(), "cls", "left_semi"), "likely")
    sets = stored(_full_sets(docs, text, likely.select("cls", "sig")), "sets")
    found = _settle_groups(likely, sets)
    labelled = likely.join(found, "cls", "left").select("cls", "n", F.coalesce("label", "cls").alias("label"))
    sizes = labelled.groupBy("label").agg(F.ceil(F.count("*") / PART).alias("parts"))
    labels = stored(labelled.join(sizes, "label").select("cls", "n", "label", F.xxhash64("label", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("gid")), "labels")

    # the matrix, for shingles of more than one label
    rows = shared.select("token", "cls").join(labels, "cls")
    often = rows.groupBy("token").agg(F.countDistinct("label").alias("often")).where("often > 1")
    behind = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("often"), F.desc("token")))
    asked = stored(rows.join(often, "token").withColumn("behind", behind), "asked")
    matrix = asked.select("token", F.col("label").alias("other")).distinct()
    alike = stored(_alike(stored(_near(asked), "near"), labels, sets), "alike")
    counted = alike.select("cls", "other").join(asked.select("cls", "token"), "cls").join(matrix, ["other", "token"])
    met = alike.join(counted.groupBy("cls", "other").agg(F.count("*").alias("c")), ["cls", "other"]).where(_reached())
    met = stored(met.select("cls", "n", "label", "other", "several", "only"), "met")

    # labels that qualify and have several parts are counted again by part
    inside = asked.select("token", F.col("label").alias("other"), F.col("gid").alias("open")).distinct()
    spans = labels.groupBy(F.col("gid").alias("open")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    several = met.where("several").select("cls", "n", "label", "other").join(asked.select("cls", "token"), "cls")
    counted = several.join(inside, ["other", "token"]).groupBy("cls", "n", "label", "open").agg(F.count("*").alias("c"))
    opened = counted.join(spans, "open").where(_reached()).select("cls", "label", F.col("open").alias("gid"))
    pairs = stored(opened.unionByName(met.where("not several").select("cls", "label", F.col("only").alias("gid"))), "pairs")

    # groups to open, with the sets of their members and of those that ask
    turns = pairs.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).alias("turns"))
    members = sets.select("cls", "members")
    # stored, their size is known, and where it is small the sets stay in place
    ask = pairs.join(turns, "gid").select(
        "cls", F.col("gid").alias("q_gid"), F.pmod(F.xxhash64("cls"), F.col("turns")).alias("q_turn"), F.col("label").alias("q_label")
    )
    ask = stored(ask, "ask").join(members.withColumnRenamed("members", "query"), "cls")
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)).alias("turn")
    answer = stored(labels.join(turns, "gid").select("gid", "cls", "label", turn), "answer").join(members, "cls")
    links = answer.groupBy("gid", "turn").cogroup(ask.groupBy("q_gid", "q_turn")).applyInArrow(_opened, "a long, b long")
    roots = contract(links)

    joined = labels.select("cls", "label").join(roots.withColumnRenamed("node", "label"), "label", "left").select("cls", F.coalesce("root", "label").alias("root"))
    named = stored(joined.join(classes.select("cls", "sig", "id"), "cls"), "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked_ids = named.join(least, "root").select("cls", "component_id")
    final = stored(classes.join(linked_ids, "cls", "left").select("sig", F.coalesce("component_id", "id").alias("component_id")), "final")
    return signed.select(key, F.col("n").alias("n_shingles"), "sig").join(final, "sig", "left").select(
        key, "n_shingles", F.when(F.col("sig").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one with the smallest id.

    Of equal ids the one with the smaller hash of its text; a null id counts as larger than any other.
    Of rows with equal id and text one stays.
    """
    name, rank = free_name(docs.columns, "_key"), free_name(docs.columns, "_rank")
    own = F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("h"))
    named = docs.withColumn(name, own)
    found = stored(components(named.select(name, text), name, text), "components")
    gone = found.where(~F.col(name).eqNullSafe(F.col("component_id"))).select(name).distinct()
    again = found.groupBy(name).count().where("count > 1").select(name)
    gone, again = _sent(gone, name), _sent(again, name)
    kept = named.join(gone, named[name].eqNullSafe(gone["_gone"]), "left_anti")
    order = Window.partitionBy(name).orderBy(F.col(text))
    repeats = kept.join(again, kept[name].eqNullSafe(again["_gone"]), "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return kept.join(again, kept[name].eqNullSafe(again["_gone"]), "left_anti").unionByName(repeats.drop(rank)).select(*docs.columns)


def _sent(ids: DataFrame, name: str) -> DataFrame:
    """A list of ids: sent to all tasks where its size allows, else joined by a shuffle."""
    ids = stored(ids.select(F.col(name).alias("_gone")), "ids")
    return F.broadcast(ids) if ids.count() <= LISTED else ids

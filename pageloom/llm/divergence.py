"""Source divergence audit over single-pass in-memory indexes.

Each task reads its documents once and builds postings (language, term) -> source -> occurrences and
documents in memory; when ``POSTINGS`` are held they are written out as a run, sorted by term, in
blocks per hash shard, and memory starts anew.  A shard's blocks arrive in order of their first term
and a heap merges them, so that a term's postings of all runs meet without the shard being held.  Terms
in at least ``LEAST`` documents of their language are kept, with the occurrences in each source.

With smoothed frequencies p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), the divergence of two groups is
the sum over all kept terms of f = floor((p - q)^2 / (p + q)).  Terms that neither group has give one
constant; terms that one group has depend on their count alone and are summed by count; only terms that
both have are corrected pair by pair, streamed through a matrix of running sums.  All of it is exact in
64 bits.

Cases: null text, lang or source - empty; texts without terms - their group still counts; very long
texts - read in pieces; repeated rows - counted as often; languages without kept terms - pairs of value 0;
one source alone - no pairs; empty table - empty result; other columns - ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import pickle
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import shuffle_parts, slices, stored

LEAST = 10
SCALE = 1_000_000_000
TOP = 10
# (term, document) entries in memory before a run is written, terms of a block of a run, and terms that
# wait at most, besides one block of each run, while blocks are merged
POSTINGS = 2_000_000
BLOCK = 4096
WINDOW = 1 << 17
# bytes of a text that are split into terms at once
PIECE = 1 << 20
# pairs of one step of the corrections
PAIRS = 1 << 20

# A to Z fold, letters and bytes of other characters stay, the rest parts terms
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCKS = "shard int, lang string, term string, block binary"
FREQUENCIES = "lang string, term string, postings array<struct<source: string, count: bigint>>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; pieces end between terms."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        to = folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


class Run:
    """Postings in memory: of each language, a number for every term, and (term, document) entries."""

    def __init__(self) -> None:
        # one list of term numbers and one of occurrences; documents follow each other in both
        self.terms: dict = defaultdict(lambda: defaultdict(itertools.count().__next__))
        self.entries: dict = defaultdict(lambda: (array("i"), array("q"), array("i"), array("q")))
        self.sources: dict = defaultdict(lambda: defaultdict(itertools.count().__next__))
        self.held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        found: Counter = Counter()
        for piece in terms(text):
            found.update(piece)
        codes, counts, sources, lengths = self.entries[lang]
        codes.extend(map(self.terms[lang].__getitem__, found))
        counts.extend(found.values())
        sources.append(self.sources[lang][source])
        lengths.append(len(found))
        self.held += len(found)

    def blocks(self, shards: int) -> Iterator[tuple]:
        """(shard, language, first term, packed postings), each shard's postings by language and term."""
        for lang in sorted(self.terms):
            names, salt = list(self.terms[lang]), zlib.crc32(lang.encode())
            shard = np.fromiter((zlib.crc32(t, salt) for t in names), np.int64, len(names)) % shards
            order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
            order = order[np.argsort(shard[order], kind="stable")]
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            codes, counts, sources, lengths = (np.frombuffer(x, x.typecode) for x in self.entries[lang])
            known = list(self.sources[lang])
            key = rank[codes] * len(known) + np.repeat(sources, lengths)
            at = np.argsort(key)
            key = key[at]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            n, docs = np.add.reduceat(counts[at], starts), np.diff(starts, append=len(key))
            place, source = np.divmod(key[starts], len(known))
            begins = np.searchsorted(place, np.arange(len(names) + 1))
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            for own in np.flatnonzero(np.diff(bounds)).tolist():
                for low in range(bounds[own], bounds[own + 1], BLOCK):
                    high = min(low + BLOCK, bounds[own + 1])
                    cut = slice(begins[low], begins[high])
                    used, local = np.unique(source[cut], return_inverse=True)
                    block = (
                        [names[i] for i in order[low:high]],
                        np.diff(begins[low : high + 1]),
                        [known[i] for i in used],
                        local.astype(np.int32),
                        n[cut],
                        docs[cut],
                    )
                    yield own, lang, block[0][0].decode(), pickle.dumps(block, 5)


def _indexer(shards: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = Run()

        def spilled():
            for shard, lang, term, block in run.blocks(shards):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "lang": [lang], "term": [term], "block": [block]})

        for batch in slices(batches, 64):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                run.add(lang, source, text)
                if run.held >= POSTINGS:
                    yield from spilled()
                    run = Run()
        yield from spilled()

    return index


class Merge:
    """The blocks of one shard and language, merged by a heap of what comes next in each."""

    def __init__(self, least: int) -> None:
        self.least, self.heap, self.held, self.n = least, [], 0, 0
        self.sources: dict = defaultdict(itertools.count().__next__)

    def push(self, block: tuple) -> None:
        heapq.heappush(self.heap, (block[0][0], self.n, block, np.concatenate([[0], np.cumsum(block[1])]), 0))
        self.n, self.held = self.n + 1, self.held + len(block[0])

    def until(self, bound: bytes | None) -> pa.StructArray | None:
        """(term, postings) of the kept ones among all terms before ``bound``."""
        names, lengths, sources, counts, docs = [], [], [], [], []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, n, block, begins, at = heapq.heappop(self.heap)
            to = len(block[0]) if bound is None else bisect.bisect_left(block[0], bound, at)
            if to < len(block[0]):
                heapq.heappush(self.heap, (block[0][to], n, block, begins, to))
            self.held -= to - at
            cut = slice(begins[at], begins[to])
            names += block[0][at:to]
            lengths.append(block[1][at:to])
            sources.append(np.fromiter(map(self.sources.__getitem__, block[2]), np.int64, len(block[2]))[block[3][cut]])
            counts.append(block[4][cut])
            docs.append(block[5][cut])
        if not names:
            return None
        ids: dict = defaultdict(itertools.count().__next__)
        code = np.fromiter(map(ids.__getitem__, names), np.int64, len(names))
        code = np.repeat(code, np.concatenate(lengths))
        source, count = np.concatenate(sources), np.concatenate(counts)
        order = np.argsort(code)
        total = np.add.reduceat(np.concatenate(docs)[order], np.searchsorted(code[order], np.arange(len(ids))))
        kept = total >= self.least
        here = kept[code]
        key = code[here] * len(self.sources) + source[here]
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(starts):
            return None
        sums = np.add.reduceat(count[here][order], starts)
        owner, source = np.divmod(key[starts], len(self.sources))
        offsets = np.searchsorted(owner, np.append(np.flatnonzero(kept), len(kept)))
        postings = pa.StructArray.from_arrays([pa.array(list(self.sources)).take(pa.array(source)), pa.array(sums)], ["source", "count"])
        words = [w.decode() for w, k in zip(ids, kept.tolist()) if k]
        return pa.StructArray.from_arrays([pa.array(words), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), postings)], ["term", "postings"])


def _merger(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Merge(least)

        def out(found):
            lang = pa.array([now[1]] * len(found))
            return pa.RecordBatch.from_arrays([lang, found.field(0), found.field(1)], names=["lang", "term", "postings"])

        for batch in slices(batches, 16):
            for shard, lang, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                entries, found = pickle.loads(block), None
                if (shard, lang) != now:
                    found = state.until(None)
                elif state.held >= WINDOW:
                    found = state.until(entries[0][0])
                if found is not None:
                    yield out(found)
                if (shard, lang) != now:
                    now, state = (shard, lang), Merge(least)
                state.push(entries)
        found = state.until(None)
        if found is not None:
            yield out(found)

    return merge


def index(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Kept terms of each language with their occurrences by source (lang, term, postings)."""
    shards = shuffle_parts(docs.sparkSession)
    runs = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_indexer(shards), BLOCKS)
    dealt = runs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "term")
    return dealt.select("shard", "lang", "block").mapInArrow(_merger(least), FREQUENCIES)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept))."""
    part = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", part, (total + 2 * kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of what two sources that both have the term add to the sums by count."""
    sums: dict = defaultdict(int)
    ids: dict = {}

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    def add(first, second, p, base):
        a, b = first
        pa_, pb, oa, ob = p[a], p[b], base[a], base[b]
        worth = f(pa_, pb) - f(pa_, ob) - f(oa, pb) + f(oa, ob)
        low, high = np.minimum(*second), np.maximum(*second)
        pairs, where = np.unique(low << 32 | high, return_inverse=True)
        for pair, total in zip(pairs.tolist(), _sums(where, worth, len(pairs))):
            sums[pair] += total

    for batch in batches:
        langs, lists = batch.column(0).to_pylist(), batch.column(1)
        values = lists.flatten()
        sources = values.field(0).to_pylist()
        p, base = values.field(1).to_numpy(False), values.field(2).to_numpy(False)
        ends = np.cumsum(lists.value_lengths().to_numpy())
        lengths = np.diff(ends, prepend=0)
        lang_of = np.repeat(np.arange(len(langs)), lengths)
        code = np.array([ids.setdefault((langs[r], s), len(ids)) for r, s in zip(lang_of.tolist(), sources)], np.int64)
        # every posting meets those after it in its list, one distance at a time
        place = np.arange(len(code)) - np.repeat(ends - lengths, lengths)
        rest = np.repeat(lengths, lengths) - place
        held: list = []
        size = 0
        for step in range(1, int(lengths.max(initial=0))):
            a = np.flatnonzero(rest > step)
            held.append((a, a + step))
            size += len(a)
            if size >= PAIRS:
                a, b = (np.concatenate(x) for x in zip(*held))
                add((a, b), (code[a], code[b]), p, base)
                held, size = [], 0
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            add((a, b), (code[a], code[b]), p, base)
    names = list(ids)
    found = list(sums.items())
    for at in range(0, len(found), 10_000):
        part = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in found[at : at + 10_000]]
        yield pa.RecordBatch.from_pydict(
            {"lang": [a[0] for a, _, _ in part], "source": [a[1] for a, _, _ in part], "item": [b[1] for _, b, _ in part], "more": [v for _, _, v in part]}
        )


def _sums(where: np.ndarray, worth: np.ndarray, n: int) -> list[int]:
    """Exact sums of ``worth`` by group."""
    order = np.argsort(where, kind="stable")
    starts = np.searchsorted(where[order], np.arange(n))
    return np.add.reduceat(worth[order], starts).tolist()


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Divergence of each pair of a language's sources, and the terms that mark each source."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms_ = stored(index(named, least), "frequencies")
    single = terms_.select("lang", "term", F.inline("postings"))
    totals = single.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("own"))
    langs = terms_.groupBy("lang").agg(
        F.count("*").alias("kept"),
        F.sum(F.aggregate("postings", F.lit(0).cast("bigint"), lambda n, x: n + x["count"])).alias("lang_total"),
    )
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "own", "kept", "lang_total"])
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = stored(groups.withColumn("base", zero), "groups")

    in_lang = F.aggregate("postings", F.lit(0).cast("bigint"), lambda n, x: n + x["count"])
    counted = terms_.select("lang", "term", in_lang.alias("_all"), F.inline("postings"))
    priced = counted.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "count", "base",
        share(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("_all"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    priced = stored(priced, "priced")

    # terms above their language's share; ranks are cut within each task before rows move
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    marks = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # sums by count: what one source's terms add to the constant, against each other source's base
    by_count = priced.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("_terms"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("_other"))
    added = by_count.join(others, "lang").where(F.col("item") != F.col("source"))
    worth = F.col("_terms") * (gap(F.col("p"), F.col("_other")) - gap(F.col("base"), F.col("_other")))
    added = added.groupBy("lang", "source", "item").agg(F.sum(worth).alias("more"))
    lists = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("_list"))
    both = lists.where(F.size("_list") > 1).select("lang", "_list").mapInArrow(_corrections, "lang string, source string, item string, more bigint")
    one_way = added.unionByName(both)
    summed = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more"))
    summed = summed.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    pairs = groups.select("lang", "source", "kept", "base").join(others, "lang").where(F.col("item") != F.col("source"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left")
    constant = F.when(F.col("kept") > 0, F.col("kept") * gap(F.col("base"), F.col("_other"))).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (constant + F.coalesce("more", F.lit(0))).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(marks)

"""Benchmark decontamination: BM25 over test items, block-max WAND, then an overlap check.

Test items (cut into segments of at most ``SEGMENT`` words) are the indexed side; every passage of every
training text is a query.  Impacts are BM25 weights divided by the segment's own total, so that a score
is the share of the segment's weight that the passage holds, and every pair at or above ``least`` is
retrieved.  Passages are windows of two chunks of ``SEGMENT`` words, one chunk apart, so a segment that
was copied whole lies whole in one of them.

A passage is first bounded without opening postings: per block of segments, the sum of the block's
largest impacts of the passage's essential terms, plus the most weight its other terms can add.  Only
passages with a block that reaches ``least`` run block-max WAND over the postings.  What it retrieves
counts when the passage also holds enough of the item's question and answer (its last quarter), measured
in pairs of neighbouring words.

The index holds ``ITEMS`` items at most; more are taken in turns of that many, each over all texts.

Cases: null or empty texts or items - no match; items of one word - matched by that word alone; equal
items - all reported; repeated rows - each reported; null ids - carried; empty tables - empty result;
other columns - passed by ``drop_leaks``, not in the result of ``find_leaks``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import SHORT_STEP, ByteWords, free_name, share, steps, text_bytes

SEGMENT = 64
BLOCK = 8
ITEMS = 20_000
LEAST = 0.55
QUESTION, ANSWER = 0.6, 0.5
K1, B = 1.2, 0.75
# share of a segment's weight that its commonest terms may carry without being essential
COMMON = 0.25


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; of a single word, its own."""
    if len(words) < 2:
        return words
    return words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]


class Index:
    """Impacts of terms by segment, in posting lists with block maxima."""

    def __init__(self, items: list[tuple[int, bytes]], least: float = LEAST) -> None:
        self.least = least
        self.ids = [i for i, _ in items]
        find = ByteWords(letters_only=True)
        self.words = []
        for _, body in items:
            self.words.append(find(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0])
        owner, parts = [], []
        for i, words in enumerate(self.words):
            n = -(-len(words) // SEGMENT)
            for part in np.array_split(words, n) if n else []:
                owner.append(i)
                parts.append(part)
        self.owner = np.array(owner, np.int64)
        every = [np.unique(p, return_counts=True) for p in parts]
        flat = np.concatenate([t for t, _ in every]) if every else np.zeros(0, np.uint64)
        seg = np.repeat(np.arange(len(every)), [len(t) for t, _ in every])
        tf = np.concatenate([c for _, c in every]) if every else np.zeros(0)
        self.terms, term, df = np.unique(flat, return_inverse=True, return_counts=True)
        length = np.array([len(p) for p in parts], float)
        idf = np.log(1 + (len(parts) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / length.mean()) if parts else length
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[seg])
        impact /= np.bincount(seg, impact, len(parts))[seg] if parts else 1.0
        self.blocks = -(-len(parts) // BLOCK)
        # postings: by term, in order of segment
        order = np.lexsort((seg, term))
        self.seg, self.impact = seg[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(self.terms) else np.zeros(0)
        # plain lists for the walk over postings, and the largest impact of each (term, block)
        self.lists = self.seg.tolist(), self.impact.tolist(), self.start.tolist(), self.most.tolist()
        in_block = np.repeat(np.arange(len(self.terms)), df) * max(1, self.blocks) + self.seg // BLOCK
        heads = np.flatnonzero(np.r_[True, in_block[1:] != in_block[:-1]]) if len(in_block) else np.zeros(0, int)
        tops = np.maximum.reduceat(self.impact, heads) if len(heads) else np.zeros(0)
        self.block_top = dict(zip(in_block[heads].tolist(), tops.tolist()))
        # the commonest terms of a segment, up to a share of its weight, are not essential
        rank = np.lexsort((-df[term], seg))
        ahead = np.cumsum(impact[rank])
        first = np.searchsorted(seg[rank], np.arange(len(parts)))
        ahead -= np.r_[0.0, ahead][first][seg[rank]] if len(parts) else 0
        spare = np.zeros(len(flat), bool)
        spare[rank] = ahead <= COMMON
        rest = np.bincount(seg, impact * spare, len(parts))
        self.floor = np.zeros(self.blocks)
        np.maximum.at(self.floor, np.arange(len(parts)) // BLOCK, rest)
        # essential terms: for each, the blocks where it is essential and its largest impact there
        essential = np.flatnonzero(~spare)
        key = term[essential] * max(1, self.blocks) + seg[essential] // BLOCK
        keys, at = np.unique(key, return_inverse=True)
        top = np.zeros(len(keys))
        np.maximum.at(top, at, impact[essential])
        self.block_of, self.block_max = keys % max(1, self.blocks), top
        self.block_start = np.searchsorted(keys // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True
        # what the check of an item needs
        self.question, self.answer = [], []
        for words in self.words:
            tail = max(3, len(words) // 4)
            cut = max(0, len(words) - tail)
            self.question.append(np.unique(_pairs(words[:cut] if cut > 1 else words)))
            self.answer.append(np.unique(_pairs(words[max(0, cut - 1) :])))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, term numbers) of the words that are terms of the index."""
        places = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[places]), max(0, len(self.terms) - 1))
        good = self.terms[at] == words[places] if len(self.terms) else np.zeros(len(places), bool)
        return places[good], at[good]

    def promising(self, chunk: np.ndarray, term: np.ndarray, n_chunks: int) -> np.ndarray:
        """Of windows (chunk, chunk + 1): those where the bound of some block reaches the threshold."""
        count = self.block_start[term + 1] - self.block_start[term]
        entry = np.repeat(self.block_start[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        key = np.repeat(chunk, count) * self.blocks + self.block_of[entry]
        keys, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, self.block_max[entry], len(keys))
        # add what the next chunk has for the same block, and open windows that begin one chunk earlier
        def get(wanted: np.ndarray) -> np.ndarray:
            place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            return np.where(keys[place] == wanted, total[place], 0.0) if len(keys) else np.zeros(len(wanted))

        open_ = np.zeros(n_chunks, bool)
        if len(keys):
            bound = total + get(keys + self.blocks) + self.floor[keys % self.blocks]
            before = total + get(keys - self.blocks) + self.floor[keys % self.blocks]
            open_[keys[bound >= self.least] // self.blocks] = True
            early = keys[before >= self.least] // self.blocks - 1
            open_[early[early >= 0]] = True
        open_ |= self.floor.max(initial=0.0) >= self.least
        return np.flatnonzero(open_)

    def retrieve(self, query: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all segments whose score for the distinct terms of ``query`` reaches the threshold."""
        found = []
        least, blocks, top = self.least - 1e-9, self.blocks, self.block_top
        seg, impact, start, most = self.lists
        cursors = [[seg[start[t]], start[t], t] for t in query.tolist()]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += most[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the same bound, now with the maxima of the block that holds the pivot
            block = target // BLOCK
            near = sum([top.get(c[2] * blocks + block, 0.0) for c in cursors[: pivot + 1]])
            if near < least:
                # no segment can reach the threshold before the block ends or another list comes in
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = max(target + 1, min(to, cursors[pivot + 1][0]))
            elif cursors[0][0] == target:
                score = sum([impact[c[1]] for c in cursors[: pivot + 1]])
                if score >= least:
                    found.append((target, score))
                to = target + 1
            else:
                to = target
            ended = False
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    end = start[c[2] + 1]
                    c[1] = bisect_left(seg, to, c[1], end)
                    if c[1] < end:
                        c[0] = seg[c[1]]
                    else:
                        c[0], ended = -1, True
            if ended:
                cursors = [c for c in cursors if c[0] >= 0]
        return found


def _overlap(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 0.0


def leaks_of(index: Index, find: ByteWords, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(text, item number, score, first word, question overlap, answer overlap), one per text and item."""
    words, first, _, _ = find(data, offsets)
    sizes = np.diff(first)
    # chunks never span texts; one idle chunk follows each text, so that windows don't either
    n_chunks = -(-sizes // SEGMENT) + 1
    base = np.cumsum(n_chunks) - n_chunks
    place, term = index.lookup(words)
    if not len(place):
        return
    doc = np.searchsorted(first, place, side="right") - 1
    chunk = base[doc] + (place - first[doc]) // SEGMENT
    seen = np.unique(chunk * len(index.terms) + term)
    chunk, term = seen // len(index.terms), seen % len(index.terms)
    best: dict[tuple[int, int], tuple] = {}
    for c in index.promising(chunk, term, int(n_chunks.sum())):
        query = np.unique(term[np.searchsorted(chunk, c) : np.searchsorted(chunk, c + 2)])
        i = int(np.searchsorted(base, c, side="right")) - 1
        at = int(c - base[i]) * SEGMENT
        for segment, score in index.retrieve(query):
            item = int(index.owner[segment])
            reach = len(index.words[item])
            region = words[first[i] + max(0, at - reach) : min(first[i] + at + 2 * SEGMENT + reach, first[i + 1])]
            # an item of a single word has no pairs; its word is looked up instead
            there = _pairs(region) if reach > 1 else region
            q, a = _overlap(index.question[item], there), _overlap(index.answer[item], there)
            if q >= QUESTION and a >= ANSWER and score > best.get((i, item), (0.0,))[0]:
                best[i, item] = (score, at, q, a)
    for (i, item), (score, at, q, a) in sorted(best.items()):
        yield i, item, score, at, q, a


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", least: float = LEAST) -> Iterator[Index]:
    """One index per ``ITEMS`` test items; one index is held at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), text_bytes(text).alias("body"))
    turns = -(-rows.count() // ITEMS)
    for turn in range(turns):
        mine = rows.where(F.pmod(F.xxhash64("body", "item"), F.lit(turns)) == turn)
        yield Index([(r["item"], bytes(r["body"])) for r in mine.sort("item", "body").collect()], least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Pairs of text and test item, with score, place of the passage and both overlaps."""
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    result = spark.createDataFrame([], schema)
    for index in indexes(benchmark, least=least):
        shared = share(spark, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, find = shared(), ByteWords(letters_only=True, step=SHORT_STEP)
            for batch in batches:
                for at, to, data, offsets in steps(batch.column("_body"), SHORT_STEP):
                    rows = list(leaks_of(index, find, data, offsets))
                    if rows:
                        i, item, score, first, q, a = (np.array(c) for c in zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(key).take(pa.array(i + at)), pa.array([index.ids[k] for k in item], pa.int64()), *map(pa.array, (score, first, q, a))],
                            names=[key, "item_id", "score", "first_word", "question_overlap", "answer_overlap"],
                        )

        result = result.unionByName(docs.select(key, text_bytes(text).alias("_body")).mapInArrow(run, schema))
    return result


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """The documents without a test item, with the columns of ``docs``."""
    columns, body = docs.columns, free_name(docs.columns, "_body")
    for index in indexes(benchmark, least=least):
        shared = share(docs.sparkSession, index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, find = shared(), ByteWords(letters_only=True, step=SHORT_STEP)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                clean = np.ones(batch.num_rows, bool)
                for at, _, data, offsets in steps(batch.column(body), SHORT_STEP):
                    for row in leaks_of(index, find, data, offsets):
                        clean[at + row[0]] = False
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns], names=columns).filter(pa.array(clean))

        docs = docs.select(*columns, text_bytes(text).alias(body)).mapInArrow(run, docs.schema)
    return docs

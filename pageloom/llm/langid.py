"""Language identification by error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over hashed byte n-grams tells
the languages with a 1 from those with a 0; a text's bits are decoded to the codeword with the least
loss, each bit weighted by how well its classifier does on that codeword's language.  A text whose two
nearest codewords are close is flagged as ambiguous.

Counts come from labelled rows of Spark partitions, summed by one aggregation.  ``per_language`` bounds
the rows used for each language (expected number, chosen by a hash of the text); prediction reads every
whole text.

Cases: null text or one without a letter - ``und``, score 0; no labelled row - all ``und``; one language
only - that one, score 1; equal losses - the first language in order of name; repeated rows - predicted
alike; empty table - empty result; other columns of the input - not in the result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import STEP_BYTES, share, text_bytes

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
PER_LANGUAGE = 20_000
EXHAUSTIVE = 6
AMBIGUOUS = 0.05


def _folded() -> np.ndarray:
    """Bytes with ASCII letters in lower case and all other ASCII as space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    fold[97:123] = np.arange(97, 123)
    fold[65:91] = np.arange(97, 123)
    return fold


FOLD = _folded()


def grams(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: (first, last + 1, n-gram buckets of all orders side by side, offset of each text)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= STEP_BYTES):
            size += len(texts[to])
            to += 1
        run = texts[at:to]
        # at least four bytes a text, so that each has an n-gram of every order
        data = FOLD[np.frombuffer(b"  " + b"    ".join(run) + b"      ", np.uint8)].astype(np.uint32)
        offsets = np.cumsum([0, *(len(x) + 4 for x in run)])
        n = int(offsets[-1])
        out = np.empty((n, len(ORDERS)), np.int32)
        for k, order in enumerate(ORDERS):
            h = np.full(n, order, np.uint32)
            for j in range(order):
                h = (h ^ data[j : n + j]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            out[:, k] = h % BUCKETS
        yield at, to, out, offsets
        at = to


def codewords(n: int) -> np.ndarray:
    """n rows of bits, every column with both values, rows far apart."""
    if n <= 2:
        return np.arange(n, dtype=np.int8).reshape(n, 1)
    if n <= EXHAUSTIVE:
        # the first row is all ones; each other column tells one way to part the languages
        columns = [(1, *c) for c in itertools.product((0, 1), repeat=n - 1) if not all(c)]
        return np.array(columns, np.int8).T
    rng, best, most = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.integers(0, 2, (n, bits), dtype=np.int8)
        if (code.min(0) == code.max(0)).any():
            continue
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + bits * np.eye(n, dtype=int)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, 0 or 1
    table: np.ndarray  # buckets x bits: log-odds of a 1
    weight: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-odds of each bit over the n-grams of each text."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for at, to, found, offsets in grams(texts):
            value = self.table[found].sum(1)
            out[at:to] = np.add.reduceat(value, offsets[:-1], axis=0) / (np.diff(offsets) * len(ORDERS))[:, None]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each codeword."""
        signs = 2.0 * self.code - 1
        each = np.logaddexp(0, -SHARPNESS * signs[None] * margins[:, None, :])
        return (each * self.weight[None]).sum(2)


SHARPNESS = 8.0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a partition's labelled texts, each text scaled to the same weight."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        names, texts = batch.column("lang").to_pylist(), batch.column("body").to_pylist()
        for at, to, found, offsets in grams(texts):
            for i in range(at, to):
                own = found[offsets[i - at] : offsets[i - at + 1]].ravel()
                total = sums.setdefault(names[i], np.zeros(BUCKETS))
                total += np.bincount(own, minlength=BUCKETS) / np.sqrt(len(own))
    for name, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(np.round(total[some] * 1024).astype(np.int64))],
            names=["lang", "bucket", "n"],
        )


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Classifiers and weights from rows with a text and a language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text_bytes(text).alias("body"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), np.zeros((0, 0), np.int8), np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    languages = tuple(sorted(sizes))
    share: Column = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, per_language / sizes[name])).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < share * (1 << 20))
    counts = np.full((len(languages), BUCKETS), 0.5)
    summed = sample.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    at = {name: i for i, name in enumerate(languages)}
    places = np.array([at[x] for x in summed["lang"].to_pylist()], int)
    counts[places, summed["bucket"].to_numpy()] += summed["n"].to_numpy() / 1024
    share_of = counts / counts.sum(1, keepdims=True)
    code = codewords(len(languages))
    if len(languages) == 1:
        return Model(languages, code, np.zeros((BUCKETS, 1)), np.ones((1, 1)))
    table = np.stack([np.log(share_of[bit == 1].mean(0)) - np.log(share_of[bit == 0].mean(0)) for bit in code.T], 1)
    plain = Model(languages, code, table.astype(np.float32), np.full(code.shape, 1 / code.shape[1]))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = np.array([at[x] for x in batch.column("lang").to_pylist()], int)
            good = (plain.margins(batch.column("body").to_pylist()) > 0) == (code[own] == 1)
            for i in np.unique(own):
                hits = good[own == i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(i)] * code.shape[1]), pa.array(np.arange(code.shape[1])), pa.array(hits.sum(0).astype(np.int64)), pa.array([len(hits)] * code.shape[1])],
                    names=["lang", "bit", "good", "n"],
                )

    weight = np.full(code.shape, 1e-3)
    for r in sample.mapInArrow(right, "lang long, bit long, good long, n long").groupBy("lang", "bit").sum("good", "n").collect():
        # no better than a coin: no weight
        weight[r["lang"], r["bit"]] += max(0.0, 2 * r["sum(good)"] / r["sum(n)"] - 1)
    return Model(languages, code, plain.table, weight / weight.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language, score in [0, 1] and ambiguity flag of every text."""
    shared = share(docs.sparkSession, model)
    keep = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = batch.column("_body").to_pylist()
            named = np.array([any(map(str.isalpha, x.decode())) for x in texts], bool)
            n = len(texts)
            if model.languages:
                losses = model.losses(model.margins(texts))
                likely = np.exp(-SHARPNESS * (losses - losses.min(1, keepdims=True)))
                likely /= likely.sum(1, keepdims=True)
                best = losses.argmin(1)
                score = np.where(named, likely[np.arange(n), best], 0.0)
                gap = np.partition(losses, 1, axis=1)[:, 1] - losses.min(1) if len(model.languages) > 1 else np.ones(n)
                found = np.where(named, np.array(model.languages, object)[best], "und")
                close = named & (gap < AMBIGUOUS)
            else:
                found, score, close = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(found, pa.string()), pa.array(score), pa.array(close)],
                names=[*keep, "lang_pred", "score", "ambiguous"],
            )

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, ambiguous boolean"
    return docs.select(*keep, text_bytes(text).alias("_body")).mapInArrow(run, schema)

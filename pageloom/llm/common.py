"""What the corpus operators share: word hashing over whole Arrow buffers, scratch tables, splits.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, which is the same
as runs of such code points.  A word's 64-bit hash depends on its bytes only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import scratch_path

SEED = 0x5EED5EED
ODD = 0x9E3779B97F4A7C15
# bytes of text that one step of vectorised work takes at most (a longer text is a step of its own)
STEP_BYTES = 2 << 20
# and where nothing is gained by longer steps
SHORT_STEP = 1 << 19
# Spark's setting for the rows that a Python process gets at a time, and their number where rows hold whole texts
ARROW_ROWS, SHORT = "spark.sql.execution.arrow.maxRecordsPerBatch", 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, short: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, nothing is computed twice.

    With ``short``, Python processes get few rows at a time, for ``df`` and for what is made of the result.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    if not short:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    with short_batches(spark):
        df.write.parquet(path)
        reader = like(spark)
    return reader.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand ``SHORT`` rows at most to Python at a time; the session's setting comes back."""
    before, now = spark.conf.get(ARROW_ROWS, None), int(spark.conf.get(ARROW_ROWS))
    if not 0 < now <= SHORT:
        spark.conf.set(ARROW_ROWS, str(SHORT))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_ROWS) if before is None else spark.conf.set(ARROW_ROWS, before)


def like(spark: SparkSession) -> SparkSession:
    """A session of the same application with the present settings of ``spark``, which later ones don't reach."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    return own


def free_name(columns: list[str], name: str) -> str:
    """``name``, longer by as many underscores as it takes not to be one of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def share(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` in every task; it travels once to each executor.

    Only for values whose size has a bound.  Classes travel with it, as executors may lack the package.
    """
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        return pickle.loads(packed.value)

    return get


def forget(shared: Callable) -> None:
    """Free what ``share`` sent, once no later job needs it."""
    shared.__closure__[0].cell_contents.unpersist()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- words of many texts at once ------------------------------------------------------------


class ByteWords:
    """Words of a run of texts, found and hashed with whole-buffer array operations.

    A word's hash is a polynomial in random values of its bytes, modulo 2**64, then mixed with its
    length.  Powers are relative to the buffer and cancelled by the inverse power at the word start.
    """

    def __init__(self, letters_only: bool = False, step: int = STEP_BYTES) -> None:
        """``letters_only`` also parts words at ASCII characters that are no letter or digit; ``step`` is the
        usual size of a run of texts."""
        values = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lower = np.arange(256)
        lower[65:91] += 32
        self.exact, self.folded = values, values[lower]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        if letters_only:
            self.space[:128] = [not chr(b).isalnum() for b in range(128)]
        self.power = self.inverse = np.ones(1, np.uint64)
        self.step = step

    def _powers(self, n: int) -> None:
        if len(self.power) >= n:
            return
        size = max(n, self.step + (1 << 16))
        for name, base in (("power", ODD), ("inverse", pow(ODD, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        """(hash of each word, first word of each text and the end, start and end byte of each word)."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
        self._powers(n)
        word = ~self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | cut[1:-1]
        ends[:-1] &= ~word[1:] | cut[1:-1]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.folded if fold else self.exact)[data] * self.power[:n], dtype=np.uint64, out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * self.inverse[starts]
        return mixed(hashes + (stops - starts).astype(np.uint64)), np.searchsorted(starts, offsets), starts, stops


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last + 1, bytes, offsets from 0) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

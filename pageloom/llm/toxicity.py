"""Toxicity by weak supervision.

1. Lexicons: words and word beginnings that labelled toxic rows use far more often than the others,
   beside a short fixed list, are dealt to voters.
2. Voters say toxic, clean or nothing of a text: by lexicon hits, by density of hits, by shouting
   around hits, by the absence of any hit.
3. Label model: a generative model of the votes given the hidden class.  Each voter has a conditional
   table (its accuracy) and depends on at most one other voter, chosen as the maximum spanning tree of
   the votes' conditional mutual information (their correlations).  It is fitted by expectation
   maximisation on how often each combination of votes occurs among all texts.
4. A logistic regression on the hits of each lexicon entry is trained on the posterior labels (that of
   a labelled row is its label, with ``LABEL_WEIGHT``); it alone scores texts.

Bounds: ``max_labelled`` labels (expected number, chosen by a hash of the id), at most
``max_entries`` entries, ``max_fit`` kinds of texts with hits for the regression (expected number; texts
with equal votes, label and hits are one kind, however often they occur, and the more often, the surer it
is drawn).  Vote combinations are counted over all texts and there are at most 3 ** (number of voters).

Cases: null or empty text - no hits, the score of a clean text; no labels - fixed list and default
accuracies; equal scores of entries - by name; repeated rows - scored alike; empty table - empty result;
other columns of the input - passed by ``keep_clean``, not in the result of ``score``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.common import forget, free_name, share, slices, stored, text_bytes

# fixed values: plain insults every lexicon starts from
SEEDS = "clown disgusting dumbass filthy idiot imbecile loser moron pathetic scum scumbag stupid trash vermin worthless"
PREFIXES = (4, 5, 6)
MAX_LABELLED = 40_000
MAX_FIT = 20_000
MAX_ENTRIES = 600
GROUPS = 6
LABEL_WEIGHT = 4.0
REMEMBERED = 100_000
# rows that are turned into Python values at a time, and whose evidence is summed in a task
SLICE, COUNTED = 256, 8192
# all ASCII but letters parts words; letters in lower case, other bytes as they are
_TABLE = bytes(i + 32 if 65 <= i < 91 else i if 97 <= i < 123 or i >= 128 else 32 for i in range(256))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_TABLE).split()


def _entries(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked by a star."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


def _usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for body, flag in ((b.as_py(), t.as_py()) for b, t in zip(batch.column("body"), batch.column("toxic"))):
            (toxic if flag else clean).update({e for w in set(words_of(body)) for e in _entries(w)})
            if len(toxic) + len(clean) > 1_000_000:
                yield _usage_rows(toxic, clean)
                toxic, clean = Counter(), Counter()
    yield _usage_rows(toxic, clean)


def _usage_rows(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    names = list(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())],
        names=["entry", "n_toxic", "n_clean"],
    )


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[bytes, ...]
    group: np.ndarray  # voter group of each entry

    def hits(self):
        """A function from a text's bytes to (entry places with repeats, number of words, shouted hits)."""
        at = {e: i for i, e in enumerate(self.entries)}

        class Seen(dict):
            def __missing__(self, word):
                found = tuple(at[e] for e in _entries(word) if e in at) or None
                self[word] = found
                return found

        seen = Seen()

        def of(body: bytes) -> tuple[list[int], int, int]:
            if len(seen) > REMEMBERED:
                seen.clear()
            words = words_of(body)
            places = [i for hit in filter(None, map(seen.__getitem__, words)) for i in hit]
            shouted = 0
            if places:
                shouted = sum(1 for raw in body.split() if raw.isupper() and any(seen[w] for w in words_of(raw)))
            return places, len(words), shouted

        return of

    def votes(self, places: list[int], n_words: int, shouted: int) -> str:
        """One character per voter: + toxic, - clean, 0 nothing."""
        groups = set(self.group[places].tolist()) if places else set()
        out = ["+" if g in groups else "0" for g in range(GROUPS)]
        distinct = len(set(places))
        out.append("+" if distinct >= 4 else "-" if not distinct else "0")
        out.append("+" if n_words and len(places) / n_words > 0.005 else "0")
        out.append("+" if shouted else "0")
        out.append("-" if not places and n_words >= 20 else "0")
        return "".join(out)


def find_lexicon(labelled: DataFrame, text: str, max_entries: int) -> Lexicon:
    """Entries by how surely labelled rows tie them to toxic texts, dealt to voter groups in turn."""
    sample = labelled.where(F.col("toxic").isNotNull()).select(text_bytes(text).alias("body"), "toxic")
    sizes = sample.groupBy("toxic").count().collect()
    n_toxic = sum(r["count"] for r in sizes if r["toxic"])
    n_clean = sum(r["count"] for r in sizes if not r["toxic"])
    found: list[bytes] = []
    if n_toxic and n_clean:
        usage = sample.mapInArrow(_usage, "entry binary, n_toxic long, n_clean long").groupBy("entry").agg(
            F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")
        )
        odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
        best = usage.where(F.col("t") >= 4).select("entry", (odds * F.sqrt("t")).alias("z"), odds.alias("odds")).where("odds > 2.5")
        found = [bytes(r["entry"]) for r in best.orderBy(F.desc("z"), "entry").limit(max_entries).collect()]
    found += [w.encode() for w in SEEDS.split() if w.encode() not in found]
    return Lexicon(tuple(found), np.arange(len(found)) % GROUPS)


# -- the label model ------------------------------------------------------------------------


def fit_label_model(patterns: dict[str, tuple[float, float, float]], rounds: int = 40) -> dict[str, float]:
    """P(toxic | votes) of each pattern, from (texts, labelled toxic, labelled clean) with each pattern.

    Starts from the labelled rows (or, without them, from the majority of votes).
    """
    names = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in p] for p in names])
    n = np.array([patterns[p][0] for p in names], float)
    toxic, clean = (np.array([patterns[p][k] for p in names], float) for k in (1, 2))
    plus, minus = (votes == 2).sum(1), (votes == 0).sum(1)
    post = (toxic + np.where(plus > minus, 0.9, 0.05)) / (toxic + clean + 1)
    m = votes.shape[1]

    def table(j: int, k: int | None, w: np.ndarray) -> np.ndarray:
        """P(vote j | vote k, class) with a little smoothing; rows: class, vote k, vote j."""
        out = np.full((2, 3, 3), 0.05)
        for c, weight in enumerate((1 - w, w)):
            np.add.at(out[c], (votes[:, k] if k is not None else np.ones(len(votes), int), votes[:, j]), n * weight)
        return out / out.sum(2, keepdims=True)

    parent: list[int | None] = [None] * m
    for turn in range(rounds):
        if turn == 3:
            parent = _dependencies(votes, n, post)
        prior = np.clip((n * post).sum() / max(n.sum(), 1e-9), 1e-4, 0.6)
        log = np.log([1 - prior, prior])[:, None] + np.zeros((2, len(names)))
        for j in range(m):
            t = np.log(table(j, parent[j], post))
            k = votes[:, parent[j]] if parent[j] is not None else np.ones(len(votes), int)
            log += t[:, k, votes[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        # rows with a label keep it
        new = (new * np.maximum(n - toxic - clean, 0) + toxic) / np.maximum(n, toxic + clean)
        done, post = np.abs(new - post).max() < 1e-6, new
        if done and turn > 4:
            break
    return dict(zip(names, post.tolist()))


def _dependencies(votes: np.ndarray, n: np.ndarray, post: np.ndarray) -> list[int | None]:
    """For each voter the one it depends on: maximum spanning tree of conditional mutual information."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for j in range(m):
        for k in range(j):
            for weight in (n * post, n * (1 - post)):
                joint = np.full((3, 3), 1e-6)
                np.add.at(joint, (votes[:, j], votes[:, k]), weight)
                p = joint / joint.sum()
                info[j, k] += weight.sum() * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum()
    info += info.T
    parent: list[int | None] = [None] * m
    done = [0]
    while len(done) < m:
        j, k = max(((j, k) for j in range(m) if j not in done for k in done), key=lambda e: info[e])
        # weak ties stay out: the voters are then independent given the class
        parent[j] = k if info[j, k] > 1e-3 * n.sum() else None
        done.append(j)
    return parent


# -- the classifier -------------------------------------------------------------------------


@dataclass(frozen=True)
class Scorer:
    lexicon: Lexicon
    weight: np.ndarray  # one per entry, then one for any hit, then the constant

    def function(self):
        of, weight, k = self.lexicon.hits(), self.weight, len(self.lexicon.entries)

        def score(body: bytes) -> float:
            places, n_words, _ = of(body)
            z = weight[-1]
            if places:
                found = Counter(places)
                z += weight[k] + sum(weight[i] * np.log1p(c) for i, c in found.items())
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with soft labels by Newton steps; the last column is the constant."""
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        beta += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-5:
            break
    return beta


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn,
    text: str = "text",
    max_labelled: int = MAX_LABELLED,
    max_entries: int = MAX_ENTRIES,
    max_fit: int = MAX_FIT,
) -> Scorer:
    """A scorer from all texts and those labels whose document satisfies ``learn`` (a condition on doc_id).

    ``labels`` has doc_id and toxic; of several labels of one id the largest counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marks = marks.where(learn)
    part = min(1.0, max_labelled / max(1, marks.count()))
    # no more labels than the bound, so they go to the texts and no text moves
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < part * (1 << 20))
    joined = docs.select("doc_id", text).join(F.broadcast(marks), "doc_id", "left")
    lexicon = find_lexicon(joined, text, max_entries)
    shared = share(docs.sparkSession, lexicon)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared()
        of = lexicon.hits()
        for batch in slices(batches, COUNTED):
            counts: Counter = Counter()
            for piece in slices([batch], SLICE):
                for body, toxic in zip(piece.column("body").to_pylist(), piece.column("toxic").to_pylist()):
                    hits = of(body)
                    found = sorted(Counter(hits[0]).items())
                    counts[lexicon.votes(*hits), toxic, tuple(i for i, _ in found), tuple(n for _, n in found)] += 1
            columns = [list(c) for c in zip(*counts)] + [list(counts.values())]
            kinds = [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["votes", "toxic", "at", "n", "rows"])

    # equal votes, labels and hits are one row with their number, so copies of a text cost nothing
    bodies = joined.select(text_bytes(text).alias("body"), "toxic")
    evidence = bodies.mapInArrow(seen, "votes string, toxic boolean, at array<int>, n array<int>, rows long")
    evidence = stored(evidence.groupBy("votes", "toxic", "at", "n").agg(F.sum("rows").alias("rows")), "evidence")
    forget(shared)
    patterns: dict[str, list[float]] = {}
    for r in evidence.groupBy("votes", "toxic").agg(F.sum("rows").alias("rows")).collect():
        entry = patterns.setdefault(r["votes"], [0.0, 0.0, 0.0])
        entry[0] += r["rows"]
        if r["toxic"] is not None:
            entry[1 if r["toxic"] else 2] += r["rows"]
    k = len(lexicon.entries)
    if not patterns:
        return Scorer(lexicon, np.r_[np.full(k, 2.0), 0.0, -3.0])
    posterior = fit_label_model({p: tuple(v) for p, v in patterns.items()})

    # evidence for the regression: without hits there are no more kinds than patterns; of the others each
    # is drawn with a chance that grows with its rows, and weighs as many as it stands for
    n_hit = evidence.where("size(at) > 0").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    chance = F.when(F.size("at") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("rows") * (max_fit / max(1.0, n_hit))))
    u = F.pmod(F.xxhash64("votes", "toxic", "at", "n", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    drawn = evidence.select("votes", "toxic", "at", "n", (F.col("rows") / chance).alias("w"), chance.alias("chance"), u.alias("u"))
    got = drawn.where("u < chance").orderBy("votes", "toxic", "at", "n").collect()
    x = np.zeros((len(got), k + 2), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(got):
        x[i, r["at"]] = np.log1p(r["n"])
        x[i, k] = bool(r["at"])
    # the posterior of a row with a label is its label
    known = np.array([r["toxic"] is not None for r in got], bool)
    y = np.array([posterior[r["votes"]] if r["toxic"] is None else float(r["toxic"]) for r in got])
    w = np.array([r["w"] for r in got]) * np.where(known, LABEL_WEIGHT, 1.0)
    return Scorer(lexicon, _regression(x, y, w))


def _scored(docs: DataFrame, scorer: Scorer, text: str, columns: list[str], least: float | None, schema) -> DataFrame:
    shared = share(docs.sparkSession, scorer)
    # a text that is carried is read from its own column
    carried = text in columns and docs.schema[text].dataType == T.StringType()
    body = text if carried else free_name(columns, "_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared().function()
        for batch in slices(batches, SLICE):
            scores = np.array([of((x or "").encode() if carried else x) for x in batch.column(body).to_pylist()])
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in columns], names=columns)
            if least is not None:
                yield kept.filter(pa.array(scores < least))
            else:
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=[*columns, "score", "predicted"],
                )

    return docs.select(*columns, *[] if carried else [text_bytes(text).alias(body)]).mapInArrow(run, schema)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score in (0, 1) and prediction of each text, beside the columns ``carry``."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return _scored(docs, scorer, text, list(carry), None, f"{fields}, score double, predicted int")


def keep_clean(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The documents scored under 0.5, with the columns of ``docs``."""
    return _scored(docs, scorer, text, docs.columns, 0.5, docs.schema)

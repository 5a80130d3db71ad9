"""Jaccard join, decontamination, Katz model and pipeline against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from pageloom.llm import decontam, groupjoin, katz, queries
from pageloom.llm.common import table

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def near(spark):
    """Copies and chains of near copies, one group of far over a part's size, common passages."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 160]) if base else 200):
            text = list(text)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows) * 7 % 4001, " ".join(text)))
    for _ in range(60):
        rows.append((len(rows) * 7 % 4001, " ".join([word() for _ in range(40)] + passage)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_components_brute_force(spark, near, edge):
    docs = near.union(edge.select("doc_id", "text").where("doc_id is null or doc_id < 8").selectExpr("doc_id + 5000", "text"))
    rows = [tuple(r) for r in docs.collect()]
    assert Counter(tuple(r) for r in groupjoin.components(docs).collect()) == brute_components(rows)


def test_components_edges(spark, edge, empty):
    got = Counter(tuple(r) for r in groupjoin.components(edge).collect())
    assert got == brute_components([(r.doc_id, r.text) for r in edge.collect()])
    assert groupjoin.components(empty).count() == 0


def test_matrix_rows_of_a_shared_passage(spark, monkeypatch):
    """Texts with a long common part that don't link hardly meet, and those that do are found."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    own = lambda i, n: [f"w{i}x{rng.randrange(10**6)}" for _ in range(n)]
    rows = [(i, " ".join(passage + own(i, 19 + i % 2))) for i in range(150)]
    tail = own(999, 120)
    rows += [(200 + i, " ".join(tail[: 120 - 4 * i])) for i in range(12)]
    seen, kept = {}, groupjoin.stored

    def store(df, name):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(groupjoin, "stored", store)
    monkeypatch.setattr(groupjoin, "KEYS", 1)
    monkeypatch.setattr(groupjoin, "_candidates", lambda rows: rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in groupjoin.components(docs).collect()) == brute_components(rows)
    asked = seen["asked"].select("token", "cls", "label")
    met = asked.join(asked.select("token", F.col("label").alias("other")).distinct(), "token").where("label <> other")
    assert met.count() > 50_000 and seen["near"].count() < 1000


def test_parity_bits_part_what_shares_much(spark, monkeypatch):
    """Texts that share most of their shingles without a link are told apart before their shingles meet."""
    rng = random.Random(4)
    rows = [(i, " ".join([f"p{i // 6}x{k}" for k in range(150)] + [f"w{i}x{k}" for k in range(40)])) for i in range(180)]
    rows += [(200 + i, " ".join([f"t{i // 3}x{k}" for k in range(90)] + [f"e{i}x{rng.randrange(99)}" for _ in range(8)])) for i in range(30)]
    sets = [np.sort(np.array([hash(x) % 2**64 for x in shingles(t)], np.uint64)) for _, t in rows]
    for a, b in zip(sets, sets[1:]):
        bits = groupjoin.parity(a).view(np.uint64) ^ groupjoin.parity(b).view(np.uint64)
        assert np.bitwise_count(bits).sum() <= len(np.setxor1d(a, b))
    seen, kept = {}, groupjoin.stored

    def store(df, name):
        seen[name] = kept(df, name)
        return seen[name]

    monkeypatch.setattr(groupjoin, "stored", store)
    monkeypatch.setattr(groupjoin, "KEYS", 1)
    monkeypatch.setattr(groupjoin, "_candidates", lambda rows: rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in groupjoin.components(docs).collect()) == brute_components(rows)
    assert seen["near"].count() > 300 and seen["alike"].count() < 100


def test_links_that_are_stars_are_not_contracted(spark, monkeypatch):
    made, kept = [], groupjoin.stored
    monkeypatch.setattr(groupjoin, "stored", lambda df, name: made.append(name) or kept(df, name))
    stars = [(i, i % 7) for i in range(7, 60)] + [(3, 3)]
    got = groupjoin.contract(spark.createDataFrame([*stars, (8, 1)], "a long, b long"))
    assert made == ["edges"]
    assert sorted(map(tuple, got.collect())) == [(i, i % 7) for i in range(7, 60)]
    for other in ([(8, 1), (8, 2)], [(9, 5), (5, 2)], [(i, i + 1) for i in range(30)]):
        up = {}
        for a, b in other:
            x, y = (up.get(k, k) for k in (a, b))
            up.update({k: min(x, y) for k in {a, b, *(k for k, v in up.items() if v in (x, y))}})
        got = groupjoin.contract(spark.createDataFrame(other, "a long, b long"))
        assert sorted(map(tuple, got.collect())) == sorted((k, v) for k, v in up.items() if k != v)
    assert groupjoin.contract(spark.createDataFrame([], "a long, b long")).count() == 0


def test_orders_end_once_few_are_linked(spark, near, monkeypatch):
    made, kept = [], groupjoin.stored
    monkeypatch.setattr(groupjoin, "stored", lambda df, name: made.append(name) or kept(df, name))
    rows = [tuple(r) for r in near.collect()]
    # an order that links no more than all classes: the first is the last one
    monkeypatch.setattr(groupjoin, "SETTLED", 1)
    assert Counter(tuple(r) for r in groupjoin.components(near).collect()) == brute_components(rows)
    assert made.count("linked") == 1


def test_shingles_of_several_sets(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(-700, 700) if i % 9 else 5000, rng.randrange(40), False) for i in range(3000)]
    rows += [(9000, i % 400, True) for i in range(900)] + [(9001, 7, True)]
    names = defaultdict(set)
    for token, h, _ in rows:
        names[token].add(h)
    want = {(t, h) for t, h, common in rows if common or len(names[t]) > 1}
    for parts in (1, 7):
        given = spark.createDataFrame(rows, "token long, h long, common boolean").repartition(parts)
        got = [tuple(r) for r in groupjoin._several(given).collect()]
        assert len(got) == len(want) and set(got) == want
    assert groupjoin._several(given.where("false")).count() == 0


def test_keep_one(spark, near, edge):
    kept = [r.doc_id for r in groupjoin.keep_one(near).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_components([tuple(r) for r in near.collect()])})
    once = groupjoin.keep_one(edge)
    assert once.columns == edge.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8, 9, 10)] + [(True, 0)]


def test_leaks(spark, edge, empty):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    whole = {r.item_id: shingles(r.text) for r in items.collect()}
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    assert got == {(d, i) for d, s in texts.items() for i, w in whole.items() if len(s & w) >= 0.5 * len(w)}
    kept = {r.doc_id for r in decontam.drop_leaks(docs, items).collect()}
    assert kept == set(texts) - {d for d, _ in got}
    assert decontam.find_leaks(empty, items).count() == 0 and decontam.find_leaks(edge, items).count() == 0
    assert decontam.drop_leaks(edge, items).schema == edge.schema and decontam.drop_leaks(edge, items).count() == edge.count()
    assert decontam.find_leaks(docs, items.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "the cat sat on the mat")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(edge, odd).collect()} == {(4, 3), (10, 4)}


def test_leaks_of_long_and_changed_items(spark):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(3000))
    long = [word() for _ in range(150)]
    other = [[word() for _ in range(40)] for _ in range(30)]
    items = spark.createDataFrame([(i, " ".join(o)) for i, o in enumerate(other)] + [(99, " ".join(long))], "item_id long, text string")
    filler = [word() for _ in range(300)]
    changed = [w.upper() + "," if k % 9 else w for k, w in enumerate(other[3])]
    docs = [(1, filler + long + filler), (2, filler[:77] + changed + filler), (3, filler), (4, filler + other[5][:8] + filler)]
    docs = spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()} == {(1, 99), (2, 3)}


def test_block_max_wand_is_exact():
    rng = random.Random(1)
    items = [(i, " ".join(f"t{min(int(rng.expovariate(0.02)), 400)}" for _ in range(rng.randrange(3, 50))).encode()) for i in range(150)]
    index = decontam.Index(items, least=0.4)
    for _ in range(200):
        query = np.array(sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 80))))
        score = np.zeros(len(index.owner))
        for t in query:
            run = slice(index.start[t], index.start[t + 1])
            score[index.seg[run]] += index.impact[run]
        assert [i for i, _ in index.retrieve(query)] == np.flatnonzero(score >= 0.4 - 1e-9).tolist()


def katz_scores(texts, train):
    """log10 score of each text's words and end: every word and pair of the training texts counts."""
    docs = [words(t) + [None] for t in texts]
    one, two = Counter(), Counter()
    for d, used in zip(docs, train):
        if used:
            one.update(d)
            two.update(zip(["<s>"] + d[:-1], d))
    total, kinds, pair_kinds = sum(one.values()), Counter(one.values()), Counter(two.values())
    low = katz.discounts([0.0] + [float(kinds[r]) for r in range(1, 7)], 1)
    high = katz.discounts([0.0] + [float(pair_kinds[r]) for r in range(1, 7)], 1)
    p = {w: (low[c] if c <= 5 else 1) * c / total for w, c in one.items()}
    mass = sum(p.values())
    after, back, times = defaultdict(dict), {}, dict(one) | {"<s>": sum(train)}
    for (h, w), c in two.items():
        after[h][w] = (high[c] if c <= 5 else 1) * c / times[h]
    for h, seen in after.items():
        held = sum(seen.values())
        shrink = min(1, (1 - 0.5 / (times[h] + 1)) / held)
        back[h] = (1 - held * shrink) / (1 - sum(p[w] for w in seen))
        after[h] = {w: x * shrink for w, x in seen.items()}
        # every conditional distribution sums to one
        assert abs(sum(after[h].values()) + back[h] * (sum(p[w] for w in p if w not in seen) + 1 - mass) - 1) < 1e-9
    return [sum(math.log10(after[h][w] if w in after.get(h, {}) else back.get(h, 1) * p.get(w, 1 - mass)) for h, w in zip(["<s>"] + d[:-1], d)) for d in docs]


def test_katz_all_counts(spark, monkeypatch):
    """Pairs seen once count, as do those of words seen once; small blocks and buckets, so that all meet."""
    monkeypatch.setattr(katz, "BUCKET_PAIRS", 5000)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3000)
    docs = table(spark, SF, "documents").collect()
    train = [bool(zlib.crc32(str(d.doc_id).encode()) % 10) for d in docs]
    expected = dict(zip((d.doc_id for d in docs), katz_scores([d.text for d in docs], train)))
    rows = queries.op10_katz_scores(spark, SF).collect()
    found = {r.doc_id: r.score for r in rows}
    assert found.keys() == expected.keys() and len(rows) == len(docs)
    for d, log in expected.items():
        assert abs(found[d] - log) < 1e-6 * abs(log)
    one = Counter(w for d, used in zip(docs, train) if used for w in [*words(d.text), None])
    own, total = {d.doc_id: [*words(d.text), None] for d in docs}, sum(one.values())
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own[r.doc_id]), sum(w in one for w in own[r.doc_id]), total)
        base = sum(math.log10((one.get(w, 0) + 0.1) / (total + 0.1 * (len(one) + 1))) for w in own[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * abs(base)


def test_katz_edges(edge, empty):
    trained = katz.fit(edge)
    rows = katz.score(edge, trained).collect()
    assert len(rows) == edge.count()
    assert {(r.n_tokens, r.n_known) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 1)}
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert katz.score(empty, trained).count() == 0
    both = {(r.doc_id, r.n_known, round(r.score, 6)) for r in katz.evaluate(edge, F.lit(True)).collect()}
    assert both == {(r.doc_id, r.n_known, round(r.score, 6)) for r in rows}
    assert katz.evaluate(empty, F.lit(True)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in katz.evaluate(edge, F.lit(None).cast("boolean")).collect())
    untrained = katz.fit(empty)
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in katz.score(edge, untrained).collect())


def test_pipeline(spark):
    """Each stage against what it should keep of its own input."""
    import corpus_pipeline as pipeline
    from pageloom.llm import quality
    from pageloom.llm.common import stored

    docs = table(spark, SF, "documents")
    names = docs.columns
    stages = {}
    for name, stage in pipeline.STAGES:
        stages[name] = (docs, stored(stage(spark, docs, SF), "stage"))
        docs = stages[name][1]
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == names
    before, after = stages["quality rules"]
    good = {r.doc_id for r in quality.quality(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = stages["n-gram Jaccard join"]
    parts = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, _, c in parts})
    before, after = stages["benchmark decontamination"]
    items = [shingles(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in before.collect() if not any(len(shingles(r.text) & w) >= 0.5 * len(w) for w in items)}
    assert {r.doc_id for r in after.collect()} == clean
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    left = {r.doc_id for r in stages["toxicity"][1].collect()}
    # few of the toxic rows are labelled in this small table; no clean one goes
    assert all(d in left for d, t in labels.items() if t == 0)
    assert sum(labels[d] for d in left if d in labels) < 0.5 * sum(labels.values())
    assert docs.count() == len(clean)


def test_tokens_are_stored_before_they_are_decoded(spark, edge):
    """A task with both steps would keep two Python processes at a time."""
    import corpus_pipeline as pipeline

    found = pipeline.tokenise(spark, edge, SF)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    whole = queries.byte_bpe(spark)
    wanted = whole.digests(whole.encode(edge.select("doc_id", "lang", "source", "text")), keep_ids=True)
    assert found.columns == wanted.columns
    assert Counter(map(str, found.collect())) == Counter(map(str, wanted.collect()))


def test_python_gets_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    """Encoding, decoding and decontamination keep to short batches, and the session's setting comes back."""
    import corpus_pipeline as pipeline
    from pageloom.llm import bpe, common

    docs = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("text"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")
    )
    before = spark.conf.get(common.ARROW_ROWS, None)
    note = str(tmp_path / "rows")

    def told(batches, note=note):
        for batch in batches:
            with open(note, "a") as lines:
                lines.write(f"{batch.num_rows}\n")
            yield batch

    def longest():
        with open(note) as lines:
            return max(map(int, lines))

    def seen(frame):
        return frame.mapInArrow(told, frame.schema)

    try:
        spark.conf.set(common.ARROW_ROWS, "10000")
        encode = bpe.ByteBPE.encode
        monkeypatch.setattr(bpe.ByteBPE, "encode", lambda self, frame: seen(encode(self, seen(frame))))
        encoded = pipeline.tokenise(spark, docs, SF)
        assert 0 < longest() <= common.SHORT and spark.conf.get(common.ARROW_ROWS) == "10000"
        assert seen(encoded).count() == 3000 and longest() <= common.SHORT
        drop = decontam.drop_leaks
        monkeypatch.setattr(decontam, "drop_leaks", lambda frame, *a: drop(seen(frame), *a))
        assert pipeline.drop_leaks(spark, docs, SF).count() == 3000 and longest() <= common.SHORT
        assert spark.conf.get(common.ARROW_ROWS) == "10000" and seen(docs).count() == 3000 and longest() == 3000
    finally:
        spark.conf.unset(common.ARROW_ROWS) if before is None else spark.conf.set(common.ARROW_ROWS, before)

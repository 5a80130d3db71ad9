"""Quality, sharding, tokens, language, toxicity: edge cases and brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.llm import bpe, langid, quality, shards, toxicity
from pageloom.llm.common import ByteWords, table

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, lines, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        covered |= {i, i + 1, i + 2} if often[w] > 1 else set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_brute_force(spark, edge):
    extra = spark.createDataFrame([(20, "a b a b a b x\n\na b\na b\n"), (21, "#|x <y> $%&* #"), (22, "p q r p q r s p q")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").union(extra).union(table(spark, SF, "documents").select("doc_id", "text"))
    got = Counter(tuple(r) for r in quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r.doc_id, *features(r.text)) for r in docs.collect())


def test_quality_keeps_columns(edge, empty):
    kept = quality.keep_good(edge)
    assert kept.schema == edge.schema and kept.count() == 0
    assert quality.quality(empty).count() == 0


def test_quality_plan_has_no_python(edge):
    plan = quality.quality(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_shards(edge, empty):
    rows = shards.assign_shards(edge, [1.0] * 4, [1.0] * 5).collect()
    assert len(rows) == edge.count() and shards.assign_shards(empty, [1.0]).count() == 0
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(edge.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))):
        if r.doc_id is not None:
            body = (t.text or "").encode()
            assert (r.size, r.text_crc32) == (len(body) + 8, zlib.crc32(body))


def test_weights_share_out_records(spark):
    ids = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    count = {r.shard: r["count"] for r in shards.assign_shards(ids, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(count[1] / 20000 - 0.5) < 0.02 and abs(count[0] / 20000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        shards.assign_shards(ids, [1.0, 0.0])


@pytest.fixture(scope="module")
def coders():
    tokens = bpe.read_ranks(PATH)
    reference = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return tokens, bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN), reference


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abé \n\t\x1c\x85　'sdt12²ß日\U0001f600​.,-\xa0\rZ<|>"), max_size=60))
def test_bpe_equals_tiktoken(coders, text):
    tokens, codec, reference = coders
    ids = np.frombuffer(codec.encode(text), "<u4")
    assert ids.tolist() == reference.encode_ordinary(text)
    assert bpe.joined(tokens, ids) == text.encode()


def test_bpe_encodes_new_parts_together(coders):
    tokens, codec, reference = coders
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    calls, encode = [], codec.pieces.encode
    codec.pieces = type("Counted", (), {"encode": lambda self, x, **how: calls.append(1) or encode(x, **how)})()
    words = ["qzx%dvé" % i for i in range(300)] + ["a\n ", "x" * 100, "\t", "12345678"]
    texts = [" ".join(words[i:] + words[:i]) for i in range(0, 300, 7)] + ["", " ", "  a  b ", "a\n b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert len(calls) < 200


def test_bpe_merges_many_pre_tokens_in_one_text(coders):
    tokens, codec, reference = coders
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    given, encode = [], codec.pieces.encode
    codec.pieces = type("Counted", (), {"encode": lambda self, x, **how: given.extend(x) or encode(x, **how)})()
    words = [f"qzx{i}vé\x00\U0001f600" for i in range(500)] + ["\ud7ff\ue000\uffff", "\t\x1c", "í \xa0í"]
    texts = [" ".join(words), "í" + "z" * 200 + "\xa0", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]
    assert len(given) < 100


def test_bpe_query(spark, edge, empty, coders):
    codec = bpe.ByteBPE(spark, PATH, P.PATTERN)
    encoded = codec.encode(edge)
    assert codec.encode(empty).count() == 0
    for r in codec.digests(codec.decode(encoded), keep_ids=True).collect():
        assert hashlib.sha256(bytes(r.decoded)).hexdigest() == r.decoded_sha256
        assert coders[2].encode_ordinary(bytes(r.decoded).decode()) == r.ids
        assert hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 and r.n_tokens == len(r.ids)
        assert (r.score, r._body) == (3.0, 1)


def test_ranks_need_no_gap(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))


def test_codewords():
    for n in (2, 3, 4, 6, 9):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
        assert all(0 < c.sum() < n for c in code.T)


def test_language(spark, edge, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    held = langid.predict(docs.where("doc_id % 4 = 2"), model, carry=("lang",))
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    rows = langid.predict(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(edge, none).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(edge, one).collect()} == {"und", "en"}


def test_toxicity(spark, edge, empty):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    from pyspark.sql import functions as F

    scorer = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    held = toxicity.score(docs.where("doc_id % 5 = 0"), scorer).join(labels, "doc_id")
    wrong = held.where("predicted <> toxic").count()
    assert wrong / held.count() < 0.01
    rows = toxicity.score(edge, scorer).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    kept = toxicity.keep_clean(edge, scorer)
    assert kept.schema == edge.schema and kept.count() == edge.count()
    assert toxicity.score(empty, scorer).count() == 0
    # without labels or texts the fixed list still works
    bare = toxicity.fit(docs.limit(50), labels.where("false"), F.lit(True))
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, bare).collect())
    toxicity.fit(empty, labels, F.lit(True))


def test_label_model_learns_accuracies_and_correlation():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.2
    a = np.where(rng.random(20000) < 0.9, y, ~y)
    b = np.where(rng.random(20000) < 0.95, a, ~a)  # follows a, not the class
    c = np.where(rng.random(20000) < 0.8, y, ~y)
    d = np.where(rng.random(20000) < 0.8, y, ~y)
    votes = ["".join("+" if v else "-" for v in row) for row in zip(a, b, c, d)]
    seen = {v: [0, 0, 0] for v in votes}
    for v, t, known in zip(votes, y, rng.random(20000) < 0.05):
        seen[v][0] += 1
        seen[v][2 - int(t)] += int(known)
    post = toxicity.fit_label_model({k: tuple(v) for k, v in seen.items()})
    truth = {v: np.mean([t for w, t in zip(votes, y) if w == v]) for v in seen}
    assert max(abs(post[v] - truth[v]) for v in seen if seen[v][0] > 300) < 0.15


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAé \t\n\x0b日."), max_size=12), max_size=6))
def test_words(texts):
    bodies = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    hashes, first, starts, stops = ByteWords()(data, np.cumsum([0, *map(len, bodies)]))
    found = [data[a:b].tobytes() for a, b in zip(starts, stops)]
    assert found == [w for b in bodies for w in b.split()]
    assert np.diff(first).tolist() == [len(b.split()) for b in bodies]
    for i, h in enumerate(hashes):
        for j, g in enumerate(hashes):
            assert (h == g) == (found[i].lower() == found[j].lower())

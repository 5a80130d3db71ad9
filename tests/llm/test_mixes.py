"""Mixing, conversation repair, divergence: brute force and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import divergence, mixing, queries, repair
from pageloom.llm.common import table

SF = "/root/testdata/sf0.001"


# -- mixing ----------------------------------------------------------------------------------


def wanted(sizes):
    """Targets by source, as the words say it: stop at three times the size, reshare the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        open_ = [s for s in order if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return share | {s: 3 * sizes[s] for s in stopped}
        stopped |= above


def check_mix(docs, rows):
    size = {}
    for r in docs:
        size.setdefault(r.source, []).append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    got = defaultdict(list)
    for r in rows:
        got[r.source].append(r)
    assert set(got) == set(size)
    target = wanted({s: sum(n for _, n in x) for s, x in size.items()})
    for s, mine in got.items():
        assert Counter((r.doc_id, r.size) for r in mine) == Counter(size[s])
        whole = sum(n for _, n in size[s])
        assert {r.source_size for r in mine} == {whole}
        assert all(abs(r.target - target[s]) <= 1e-6 * max(1, target[s]) for r in mine)
        assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in mine)
        # no mass is lost: only the last document, rounded by its own probability, can miss
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(r.size for r in mine) + 1
        if whole:
            assert all(abs(r.copies - r.target / whole) < 1 for r in mine)


def test_mix_brute_force(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    check_mix(docs.collect(), mixing.mix(docs).collect())
    # small chunks, so that masses go up several levels
    monkeypatch.setattr(mixing, "CHUNK", 4)
    first = mixing.mix(docs).collect()
    check_mix(docs.collect(), first)
    again = mixing.mix(docs.repartition(13)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_mix_edge(spark, edge, empty):
    sources = spark.createDataFrame(
        [(i, "w " * (i % 7), s, 1) for i in range(60) for s in ("b", "a", None, "", "ü")] + [(7, "x y z", "hot", 1)] * 300 + [(8, " ", "none", 1)] * 3,
        "doc_id long, text string, source string, size int",
    )
    for docs in (edge, sources):
        check_mix(docs.collect(), mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0
    plan = mixing.mix(sources)
    taken = mixing.take(sources, plan)
    assert taken.columns == sources.columns
    assert taken.count() == sum(r.copies for r in plan.collect())


def test_meeting_keeps_mass_and_means():
    random_ = np.random.default_rng(5)
    size = random_.integers(1, 500, 40) * mixing.UNIT
    mass = (size * random_.random(40)).astype(np.int64)
    mean = np.zeros(40)
    for i in range(4000):
        draw = random_.integers(-(2**62), 2**62, 40)
        after, left = mixing._meet(draw, size, mass)
        assert after.sum() == mass.sum()
        assert sum((after > 0) & (after < size)) == (left >= 0)
        mean += after / size
    assert np.abs(mean / 4000 - mass / size).max() < 0.05


# -- conversation repair -----------------------------------------------------------------------


def damaged(rows):
    after = []
    for conv_id, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        after += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted(after, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def cheapest(rows, limit):
    """Least (cost, audit, output) over all edits, by trying them all with at most ``limit`` inserts."""
    best = None
    choices = []
    for role, text, must_go, cut in rows:
        own = [("D", 2, None)]
        if not must_go:
            more = 5 if cut else 0
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(own)
    inserts = [()] + [x for n in range(1, limit + 1) for x in itertools.product(("user", "assistant"), repeat=n)]
    for edits in itertools.product(*choices):
        for puts in itertools.product(inserts, repeat=len(rows) + 1):
            audit, cost, out = "", 0, []
            for i in range(len(rows) + 1):
                for role in puts[i]:
                    audit, cost, out = audit + "I", cost + 5, out + [(role, "")]
                if i < len(rows):
                    letter, price, row = edits[i]
                    audit, cost, out = audit + letter, cost + price, out + ([row] if row else [])
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[0][:1] or "?" for r in out)):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def faults(after):
    """(role, text, must go, truncated) of each row, and the counts."""
    seen, rows, n = set(), [], Counter()
    for _, role, text in after:
        chars = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        n[kind] += 1
        rows.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
    turns = [t for t, _, _ in after if t is not None]
    first = [r[1][:1] for r in after]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return rows, (gaps, n["blank"], n["duplicate"], n["truncated"], illegal)


ROWS = st.lists(
    st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", " "]), st.sampled_from(["a.", "b!", "b", " ", "c? "])),
    max_size=4,
)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_repair_is_the_cheapest(rows):
    talk = repair.Conversation(1)
    after = [(i, role, text) for i, (role, text) in enumerate(rows)]
    told, counts = faults(after)
    seen = set()
    for turn, role, text in after:
        talk.add(turn, role, text, (role, text) in seen)
        seen.add((role, text))
    got = talk.result()
    cost, audit, out = cheapest(told, 2 if len(rows) < 3 else 1)
    assert got[1:6] == counts
    assert got[6:] == (cost, audit, hashlib.sha256(out.encode()).hexdigest())


def dynamic(rows):
    """Least (cost, audit, output) by position and state of the role pattern."""
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def put(ways):
        for _ in range(4):
            for state, (cost, audit, out) in list(ways.items()):
                for role in ("user", "assistant"):
                    to = nexts.get((state, role[0]))
                    if to is not None:
                        ways[to] = min(ways.get(to, (10**9, "", ())), (cost + 5, audit + "I", (*out, f"{role}:")))
        return ways

    ways = put({0: (0, "", ())})
    for role, text, must_go, cut in rows:
        new = {state: (cost + 2, audit + "D", out) for state, (cost, audit, out) in ways.items()}
        for state, (cost, audit, out) in ways.items():
            for name, letter, price in () if must_go else ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
                to = nexts.get((state, name[:1]))
                if to is not None:
                    new[to] = min(new.get(to, (10**9, "", ())), (cost + price + 5 * cut, audit + letter, (*out, f"{name}:{text}")))
        ways = put(new)
    cost, audit, out = min(ways[s] for s in (0, 3) if s in ways)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows):
    talks = defaultdict(list)
    for r in rows:
        talks[r[0]].append(r)
    for conv_id, mine in talks.items():
        told, counts = faults(damaged(mine))
        yield (conv_id, *counts, *dynamic(told))


def test_repair_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
        got = queries.op12_role_repair(spark, sf)
        assert Counter(map(tuple, got.collect())) == Counter(expected(rows))


def test_repair_long_and_odd_rows(spark):
    random_ = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b", "c!", None, "", "d d?", "x" * 5000 + "."]
    rows = [(c, random_.choice([None, *range(20)]), random_.choice(roles), random_.choice(texts), 1) for c in (None, 1, 2, 3, 4, 5) for _ in range(9)]
    rows += [(6, i, "system" if i % 50 == 0 else ("user", "assistant")[i % 2], f"text {i // 3}.", 1) for i in range(3000)]
    rows += [(7, i, "user", "again.", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone int")
    got = repair.repair(repair.damage(docs), F.col("gone")).collect()
    assert Counter(map(tuple, got)) == Counter(expected([r[:4] for r in rows]))
    assert repair.repair(docs.where("false")).count() == 0


# -- divergence -----------------------------------------------------------------------------------


def audited(docs, least=10, top=10):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]
        counts[lang, source].update(found)
        seen[lang].update(set(found))
    rows = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        whole = shares(sum(groups.values(), Counter()))
        p = {s: shares(c) for s, c in groups.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            marks = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t])
            rows += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            rows += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(marks[:top])]
    return Counter(rows)


def test_divergence_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = Counter(map(tuple, divergence.audit(docs, least=3).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == audited([(r.lang, r.source, r.text) for r in docs.collect()], least=3)


def test_divergence_edge(spark, edge, empty):
    rows = [("en", "s", t) for t in ("", None, "a b c", "b c d", "B! C? e")] + [("en", None, "b c"), (None, "s", "x"), ("fr", "one", "été Été ÉTÉ"), ("fr", "two", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int")
    for frame, least in ((docs, 2), (docs, 10), (edge, 2)):
        got = divergence.audit(frame, least=least).select("lang", "source", "part", "item", "value", "rank")
        assert Counter(map(tuple, got.collect())) == audited([(r.lang, r.source, r.text) for r in frame.collect()], least)
    assert divergence.audit(empty).count() == 0


def test_runs_spill_and_merge(monkeypatch):
    # many runs, blocks of few entries, and texts read in small pieces
    for name, value in (("POSTINGS", 40), ("BLOCK", 3), ("PIECE", 5), ("WINDOW", 20)):
        monkeypatch.setattr(divergence, name, value)
    random_ = random.Random(2)
    docs = [(random_.choice("xy"), random_.choice("st"), " ".join(random_.choice("abcdéfgh") * random_.randint(1, 3) for _ in range(30))) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": [d[0] for d in docs], "source": [d[1] for d in docs], "text": [d[2].encode() for d in docs]})
    blocks = [r for b in divergence._indexer(3)(iter([batch])) for r in b.to_pylist()]
    assert len(blocks) > 100
    got, counts, held = {}, defaultdict(Counter), defaultdict(Counter)
    blocks.sort(key=lambda r: (r["shard"], r["lang"].encode(), r["term"].encode()))
    dealt = pa.RecordBatch.from_pydict({"shard": [r["shard"] for r in blocks], "lang": [r["lang"] for r in blocks], "block": [r["block"] for r in blocks]})
    for b in divergence._merger(5)(iter([dealt])):
        for r in b.to_pylist():
            assert (r["lang"], r["term"]) not in got
            got[r["lang"], r["term"]] = {x["source"]: x["count"] for x in r["postings"]}
    for lang, source, text in docs:
        for term in text.split():
            counts[lang, term][source] += 1
        held[lang].update(set(text.split()))
    assert got == {k: dict(c) for k, c in counts.items() if held[k[0]][k[1]] >= 5}


def test_corrections_in_small_steps(monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 8)
    random_ = random.Random(4)
    base = {s: random_.randint(1, 50) for s in "abcdef"}
    lists = [[{"source": s, "p": random_.randint(50, 10**9), "base": base[s]} for s in random_.sample("abcdef", random_.randint(2, 6))] for _ in range(50)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("base", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(lists, kind)], names=["lang", "_list"])
    got = Counter()
    for b in divergence._corrections(iter([batch])):
        for r in b.to_pylist():
            got[frozenset((r["source"], r["item"]))] += r["more"]
    f = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for x in lists:
        for a, b in itertools.combinations(x, 2):
            want[frozenset((a["source"], b["source"]))] += f(a["p"], b["p"]) - f(a["p"], b["base"]) - f(a["base"], b["p"]) + f(a["base"], b["base"])
    assert got == want


def test_share_is_exact(spark):
    cases = [(0, 0, 1), (5, 10**13, 10**6), (6 * 10**11, 10**13, 10**9), (10**12, 10**12 + 7, 3)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in df.collect())

"""Operators 11 to 13 against brute force, with edge tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import divergence, forest, merkle

# ---- 11 ----

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def audited(rows, least, ranks):
    in_docs, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOW) for w in TERM.findall(text or "")]
        sources[lang].add(source)
        counts[lang, source].update(words)
        in_docs[lang].update(set(words))
    out = set()
    for lang, named in sources.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        size = {s: sum(counts[lang, s][t] for t in kept) for s in named}
        p = {s: {t: share(counts[lang, s][t], size[s]) for t in kept} for s in named}
        q = {t: share(sum(counts[lang, s][t] for s in named), sum(size.values())) for t in kept}
        for s in named:
            pairs = sorted((-sum(abs(p[s][t] - p[h][t]) for t in kept), h.encode(), h) for h in named - {s})
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", h, -v, k) for k, (v, _, h) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:ranks], 1)}
    return out


@pytest.mark.parametrize("blocks", [1 << 19, 20])
def test_divergence_by_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", blocks)
    monkeypatch.setattr(divergence, "ENTRIES", 40)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 16)
    monkeypatch.setattr(divergence, "PEER_ROWS", 2)
    rnd = random.Random(3)
    words = [*"abcdefghij", "Éa", "ÉA", "x1y", "日本", "don't", "UPPER", "upper"]
    rows = []
    for k in range(300):
        source = rnd.choice(["s0", "s0", "s0", "s1", "Z", "é", None])
        weights = [1 + (len(str(source)) * i) % 7 for i in range(len(words))]
        rows.append((rnd.choice(["en", "de", None]), source, rnd.choice([" ", "\n", "--"]).join(rnd.choices(words, weights, k=rnd.randint(0, 30)))))
    rows += [("en", "s0", None), ("en", "silent", "123 456"), ("fr", "one", "rare words"), ("xx", "a", ""), ("xx", "b", None), ("en", "s1", "long " * 5000), ("en", "s0", "a b"), ("en", "s0", "a b")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "lang string, source string, text string, term string, n int").repartition(3)
    got = [tuple(r) for r in divergence.audit(docs, 8, 5).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, 8, 5)
    assert {r for r in got if r[0] == "xx"} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_rows_are_dense_sums():
    """The kernel alone against a dense difference of the shares, baselines above, between and below the held shares."""
    rng = np.random.default_rng(1)
    groups, terms = 6, 40
    base = rng.integers(1, 50, groups)
    dense = np.where(rng.random((groups, terms)) < 0.4, base[:, None] + rng.integers(1, 90, (groups, terms)), base[:, None])
    g, t = np.nonzero(dense != base[:, None])
    import pyarrow as pa

    index = pa.RecordBatch.from_arrays([pa.array(t), pa.array(g), pa.array(dense[g, t])], names=["term", "g", "p"])
    for row, others, value in divergence.peer_rows(list(enumerate(base.tolist())), terms, index):
        assert value.tolist() == [int(np.abs(dense[row] - dense[h]).sum()) for h in others]


# ---- 12 ----


def nearest(ids, rows, q, k=5):
    x = rows / np.linalg.norm(rows, axis=1)[:, None]
    cos = x @ x[q]
    order = sorted((c for c in range(len(ids)) if c != q), key=lambda c: (-round(cos[c], 13), ids[c]))
    return [int(ids[c]) for c in order[:k]], cos


def listed(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("clusters", [0, 40])
def test_forest_recall(spark, clusters):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(4000, 32))
    if clusters:
        rows = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 4000)] * 4 + rows
    df = spark.createDataFrame([(k, r.tolist(), "x", 1.0) for k, r in enumerate(rows)], "vec_id long, embedding array<float>, cell string, score double").repartition(5)
    rows = rows.astype(np.float32).astype(float)
    got = listed(forest.neighbours(df, lambda i: i % 50 == 0))
    assert set(got) == set(range(0, 4000, 50))
    hits = 0
    for q, found in got.items():
        want, cos = nearest(np.arange(4000), rows, q)
        assert len(found) == 5 and all(abs(s - cos[v]) < 1e-12 for v, s in found)
        hits += len(set(want) & {v for v, _ in found})
    assert hits / (5 * len(got)) >= 0.93


def test_forest_visits_little_of_clustered_rows():
    """The walk of a query among near rows is short, that of a lone one long."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 48))
    unit = forest.unit_rows(centres[rng.integers(0, 64, 8000)] + 0.05 * rng.normal(size=(8000, 48)))
    trees = forest.Trees(0, 0, np.zeros((0, 0, 48)), np.zeros((0, 0)), unit[:2000])
    depth = 7
    trees.depth, trees.planes = depth, rng.normal(size=(3, 2**depth - 1, 48))
    trees.planes /= np.linalg.norm(trees.planes, axis=2, keepdims=True)
    trees.cuts = np.zeros((3, 2**depth - 1))
    near = [len(trees.walk(u, 0.99, 0.02)) for u in unit[:50]]
    far = [len(trees.walk(u, 0.3, 0.02)) for u in unit[:50]]
    assert np.mean(near) < 12 < 100 < np.mean(far)


def test_forest_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(forest, "HELD_ROWS", 3)
    monkeypatch.setattr(forest, "REMEMBERED", 2)
    monkeypatch.setattr(forest, "QUERY_BYTES", 64)
    inf = float("inf")
    same = [(k, [1.0, 2.0, 3.0]) for k in range(0, 400, 10)]  # queries among them
    scaled = [(k + 1, [2.0, 4.0, 6.0]) for k in range(0, 100, 10)]
    odd = [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, None, 2.0]), (1150, [1.0, inf, 0.0]), (1200, [float("nan"), 1.0, 1.0]), (1250, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (1300, [])]
    big = [(1350, [1e300, 2e300, 3e300]), (1351, [1e-300, 2e-300, 3.1e-300])]
    rows = same + scaled + odd + big + [(0, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query string").repartition(4)
    got = listed(forest.neighbours(df, lambda i: i % 50 == 0))
    assert set(got) == {*range(0, 400, 50), 1350}
    equal = sorted({i for i, v in same + scaled + big[:1]})
    for q, found in got.items():
        assert [v for v, _ in found] == [i for i in equal if i != q][:5]
        assert len({s for _, s in found}) == 1 and abs(found[0][1] - 1) < 1e-15
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert listed(forest.neighbours(few, lambda i: i % 50 == 0)) == {0: [(1, 0.0), (2, -1.0)]}
    assert forest.neighbours(few.limit(0), lambda i: i % 50 == 0).count() == 0
    assert forest.neighbours(few.where("vec_id = 0"), lambda i: i % 50 == 0).count() == 0
    assert forest.neighbours(few, lambda i: i < 0).count() == 0


# ---- 13 ----

H = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()


def proven(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(text(r[0]), text(r[1]), text(r[2]), text(r[3]), text(t))

    def tree(level):
        made = [level]
        while len(made[-1]) > 1:
            made.append([H(*made[-1][a : a + 16]) for a in range(0, len(made[-1]), 16)])
        return made

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r, leaf(r, r[4])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {s: tree([h for _, h in by[s]]) for s in names}
    upper = tree([trees[s][-1][0] for s in names])
    out = []
    for nth, s in enumerate(names):
        for place, (r, h) in enumerate(by[s]):
            way = []
            for levels, at in ((trees[s], place), (upper, nth)):
                for level in levels[:-1]:
                    a = at // 16 * 16
                    way.append((level[a:at], level[at + 1 : a + 16]))
                    at //= 16
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, r[4].translate(LOW)) if hit else h
            for a, b in way:
                now = H(*a, now, *b)
            out.append((r[0], h, trees[s][-1][0], upper[-1][0], H(*[x for a, b in way for x in a + b]), now, now == upper[-1][0]))
    return sorted(out, key=str)


SOURCES = [["a", "é", None, "zz", "Z"][k % 5] if k % 11 else f"s{k}" for k in range(620)]
TABLES = [
    [],
    [(1, "a", "en", 3, "Abc")],
    [(1, "a", None, None, None)] * 2 + [(None, None, None, None, "ABC"), (5, "b", "", 0, "")],
    [(k, "one", "en", k, f"Text {k}") for k in range(17)],
    [(k if k % 7 else None, s, "en" if k % 3 else None, k, "Ab" * k if k % 4 else None) for k, s in enumerate(SOURCES)] + [(3, "é", "en", 3, "Ab" * 60_000)],
]


@pytest.mark.parametrize("rows", TABLES, ids=["empty", "one", "repeats", "a run and one", "many sources"])
def test_merkle_by_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars int, text string, leaf string, place int").repartition(3)
    got = merkle.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == proven(rows)


def test_merkle_every_tampered_letter_shows(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "en", 5, f"Text{k}") for k in range(60)], "doc_id long, source string, lang string, n_chars int, text string")
    got = merkle.manifest(docs, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == 60 and all(r["verified"] == (r["doc_id"] % 2 == 1) for r in got)

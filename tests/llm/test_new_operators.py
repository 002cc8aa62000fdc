"""Periodic runs, embedding near-duplicates and the filter audit against plain restatements."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import embedding_dedup, filter_audit, periodic_runs
from kinloom.llm.queries import oracle_sql, queries

from . import brute
from .test_operators import INSIDE, LONG, ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(0) for c in (*INSIDE, "part", "range", "fails", "start", "length", "period", "sum", "removed")})


# ---- 11 periodic runs ------------------------------------------------------------------------------------------------------

def lyndon(w):
    """By the definition: the longest prefix of each suffix that is less than all its own suffixes."""
    is_lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
    return [max(e - i for e in range(i + 1, len(w) + 1) if is_lyndon(w[i:e])) for i in range(len(w))]


def plain_runs(w, least=12):
    """By the definition: for every period the maximal stretches of equal words at that distance; the least period counts."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        start = None
        for k in range(len(w) - q + 1):
            same = k < len(w) - q and w[k] == w[k + q]
            if same and start is None:
                start = k
            if not same and start is not None:
                n, held = k - start + q, w[start : k + q]
                if n >= max(least, 2 * q) and not any(all(held[i] == held[i + r] for i in range(n - r)) for r in range(1, q)):
                    out.append((start, n, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or n == 0:
        return w
    a, g = (h // 10) % n, h // 10
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_lyndon_arrays():
    r = random.Random(1)
    for _ in range(1500):
        w = [r.randrange(r.choice((1, 2, 3))) for _ in range(r.randrange(0, 22))]
        assert periodic_runs.lyndon_array(w) == lyndon(w), w


def test_runs_against_the_definition():
    r = random.Random(2)
    for least in (12, 5, 2):
        for _ in range(150):
            texts = []
            for _ in range(r.randrange(1, 5)):
                w = []
                while len(w) < r.randrange(0, 110):
                    w += [str(r.randrange(r.choice((1, 2, 3, 40)))).encode() for _ in range(r.randrange(1, 14))] * r.randrange(1, 5)
                texts.append(w)
            assert periodic_runs.runs_of(texts, least) == [plain_runs(w, least) for w in texts]
    assert periodic_runs.runs_of([[b"a"] * 30_000]) == [[(0, 30_000, 1)]] and periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([[]]) == [[]]


def test_runs_query(spark, sf_dir, odd, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 4000)  # several groups of texts
    rows = {r["doc_id"]: r for r in queries()["op11_baier_runs"](spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d, t in docs:
        w = planted(d, brute.words(t))
        runs, r = plain_runs(w), rows[d]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, 1000 * best[1] // best[2] if runs else None), d
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r["collapsed_sha256"] == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert sum(r["n_runs"] > 0 for r in rows.values()) >= 10


def test_runs_of_odd_rows(spark, odd):
    assert periodic_runs.find_runs(odd).count() == len([x for x in ODD for _ in plain_runs(brute.words(x[1]))])
    same = periodic_runs.collapse_runs(odd)
    assert same.columns == odd.columns and periodic_runs.find_runs(odd.limit(0)).count() == periodic_runs.collapse_runs(odd.limit(0)).count() == 0
    texts = lambda d: sorted(str(r["text"]) for r in d.select("text").collect())
    cycle = " ".join(LONG.split()[:1009])  # the long text goes round with this period
    assert texts(same) == sorted(str({LONG: cycle, LONG + " tail": cycle + " tail"}.get(x[1], x[1])) for x in ODD)
    d = spark.createDataFrame([(1, "so a b\n" + "c d e " * 5 + "f"), (1, "x " * 20), (None, "x " * 20), (2, "a b " * 5)], "doc_id long, text string")
    assert sorted(map(str, map(tuple, periodic_runs.find_runs(d).collect()))) == sorted(["(1, 3, 15, 3)", "(1, 0, 20, 1)", "(None, 0, 20, 1)"])
    assert texts(periodic_runs.collapse_runs(d)) == sorted(["so a b c d e f", "x", "x", "a b " * 5])


# ---- 12 embeddings ---------------------------------------------------------------------------------------------------------

def plain_links(rows, threshold=0.98):
    """[(n_links, component_id, kept)] of rows (id, vector, label), pair by pair in double precision."""
    fit = [v is not None and len(v) and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fit[i] and fit[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(links[i], low[root(i)], low[root(i)] == d) for i, (d, _, _) in enumerate(rows)]


@pytest.mark.parametrize("tile, block", [(1024, 8), (16, 2)])
def test_vector_links(spark, tile, block):
    r = np.random.default_rng(7)
    rows, base = [], r.standard_normal((12, 24))
    for i in range(400):  # clusters whose cosines lie around the threshold, chains, copies and a hot label
        v = base[int(r.integers(12)) if i % 4 else 0] + r.standard_normal(24) * r.choice([0.05, 0.1, 0.15])
        rows.append((i, np.float32(v if i % 9 else np.float32(base[3])).tolist(), None if i % 50 == 7 else (1 if i % 3 else int(r.integers(4)))))
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [nan] + [1.0] * 23, 1), (504, [inf] + [1.0] * 23, 1), (505, [None] + [1.0] * 23, 1), (506, [1.0, 1.0], 1), (507, [2.0, 2.0], 1),
             (508, [1e-38, 1e-38], 2), (509, [3e38, 3e38], 2), (510, [1.0, 1.0], None), (3, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]), (None, [5.0, -5.0], 3), (900, [-0.0, 1.0], 5), (901, [0.0, 2.0], 5)]
    rows = [rows[k] for k in r.permutation(len(rows))]
    d = spark.createDataFrame([(i, v, l, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, node string").repartition(3)
    got = embedding_dedup.near_duplicates(d, tile=tile, block=block)
    assert got.columns == ["vec_id", "embedding", "label", "node", "n_links", "component_id", "kept"]
    want = Counter((str(i), str(v and [float(np.float32(x)) if x is not None else None for x in v]), *w) for (i, v, l), w in zip(rows, plain_links([(i, v and [x if x is None else float(np.float32(x)) for x in v], l) for i, v, l in rows]), strict=True))
    assert Counter((str(x["vec_id"]), str(x["embedding"]), x["n_links"], x["component_id"], x["kept"]) for x in got.collect()) == want
    assert embedding_dedup.keep_one_vector(d, tile=tile, block=block).count() == sum(n for k, n in want.items() if k[-1])
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(9)
    for size in (1, 2, 64, 1500):
        x = embedding_dedup.unit_rows(r.standard_normal((60, size)) * np.exp(r.standard_normal((60, 1)) * 20))
        x[30:] = embedding_dedup.unit_rows(x[:30] + r.standard_normal((30, size)) * 0.01)
        near, error = embedding_dedup.bounds(embedding_dedup.quantised(x), embedding_dedup.quantised(x))
        assert (np.abs(near - x @ x.T) <= error).all()
        q = embedding_dedup.quantised(x)[0]
        assert (embedding_dedup.int8_product(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_far_tiles_never_hold_a_pair(spark):
    r = np.random.default_rng(10)
    x = r.standard_normal((600, 6))
    x[300:] = x[:300] + 0.1 * r.standard_normal((300, 6))
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, vector array<double>, group int")
    vectors = embedding_dedup.distinct_vectors(d)
    tiles = embedding_dedup.tiled(vectors, 20)
    of = {x["least"]: x["tile"] for x in tiles.collect()}
    packed = embedding_dedup.pack_tiles(tiles)
    met = {(p["a"], p["b"]) for p in embedding_dedup.tile_pairs(packed, 0.98).collect()}
    u = embedding_dedup.unit_rows(x)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.98, 1))
    n = packed.count()
    assert len(i) > 50 and len(met) < 0.9 * n * (n + 1) / 2
    assert all((min(of[a], of[b]), max(of[a], of[b])) in met for a, b in zip(i.tolist(), j.tolist(), strict=True))


# ---- 13 filter audit -------------------------------------------------------------------------------------------------------

def plain_audit(docs, labels):
    """Rows of the audit by walking every order over every document; docs: (id, text, source); labels: (id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = {}
    for d, t, s in docs:
        t = t or ""
        w = brute.words(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        parts.setdefault(s or "", []).append(("".join(f for f in "ABCDE" if fails[f]), d in good, d in toxic))
    out = []
    for part, held in parts.items():
        shapley = Counter()
        rows = []
        for order in permutations("ABCDE"):
            left = held
            for k, f in enumerate(order):
                went = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(went)
                rows.append((part, "".join(order), k + 1, len(left), len(went), sum(f in x[0] for x in held) - len(went), sum(x[0] == f for x in held), sum(x[1] for x in went), sum(x[2] for x in went), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = queries()["op13_filter_audit"](spark, sf_dir)
    assert sorted(got.columns) == sorted(COLUMNS)
    rows = sorted(map(tuple, got.select(*COLUMNS).collect()))
    assert rows == plain_audit(docs, labels) and sum(r[4] for r in rows) > 0


@pytest.mark.parametrize("held", [3, 1 << 18])
def test_filter_audit_of_odd_rows(spark, odd, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD", held)
    r = random.Random(5)
    bits = ["word", "Word", "#", "one two", "A", "é", "", "xyz " * 40, "\n", "p q r s t " * 12]
    docs = [(r.randrange(40) if r.random() < 0.9 else None, " ".join(r.choice(bits) for _ in range(r.randrange(0, 6))) if r.random() < 0.9 else None, r.choice(["a", "b", "", None])) for _ in range(300)]
    docs += [(70_000 * k, LONG, "far") for k in range(5)]
    labels = [(r.randrange(40), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(40)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit_filters(d, l).select(*COLUMNS).collect())) == plain_audit(docs, labels)
    got = filter_audit.audit_filters(odd, l.limit(0))
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == plain_audit([(x[0], x[1], x[3]) for x in ODD], [])
    assert filter_audit.audit_filters(odd.limit(0), l).count() == 0


def test_sorted_lists():
    r = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 60, int(n))) for n in r.choice([0, 1, 5, 60], 2))
        assert filter_audit.union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))
        assert filter_audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def test_sql_of_vectors_and_audit(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet'")
    for name in ("op12_int8_tiles", "op13_filter_audit"):
        got, want = queries()[name](spark, sf_dir.replace("sf0.001", "sf0.01")), con.execute(oracle_sql()[name])
        key = [c[0] for c in want.description]
        assert sorted(key) == sorted(got.columns) and sorted(map(tuple, got.select(*key).collect())) == sorted(want.fetchall())

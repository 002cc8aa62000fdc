import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import decontamination, jaccard_join, line_dedup, mixing, passage_dedup, pii, quality_classifier, quality_rules, sharding, warc
from kinloom.llm.common import connected_components, maybe_among_ids, running_totals, without_ids
from kinloom.llm.queries import oracle_sql, queries
from kinloom.llm.shingles import set_key, shingle_set, word_hashes

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use or used inside.
INSIDE = (
    "_t", "_text", "_spans", "_cands", "_h", "_w", "_lines", "_s", "_p", "_win", "_grams", "_hashes", "_id", "_runs", "_gone", "_k", "_cell", "_score", "_row", "_key", "_row_key", "_leak", "_source", "_size", "_copy", "_times",
    "row", "id", "block", "record_type", "content_type", "slot", "shard_bytes", "text_crc32", "text_sum", "runs", "half", "k", "cell", "words", "at", "level", "good", "g", "s", "z", "draw", "sketch", "group", "y", "run_id", "n_words", "base_failed",
)
LONG = " ".join(f"w{i * 7919 % 1009}" for i in range(3000))
ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1), (1, "one two three four five six seven eight nine ten", "en", "a", 1),
    (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 3), (5, LONG, "en", "a", len(LONG)), (6, LONG + " tail", "en", None, 9),
    (None, "only a few words here and there again", "en", "a", 1), (7, "é ü ß 漢字 words", "de", "a", 4), (8, "x" * 50_000, "en", "c", 50_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, long texts and extra columns whose names operators use inside."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"key": F.lit(1), "size": F.lit("s"), "score": F.lit(0), "shard": F.lit(9), "kept": F.lit(1), "copies": F.lit(5), "n": F.lit(2)} | {c: F.lit(0) for c in INSIDE})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50, 52: 50, 60: 60}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_running_totals(spark):
    d = spark.createDataFrame([([],), ([3],), (list(range(1300)),)], "v array<int>")
    for v, t in d.select("v", running_totals(F.col("v"))).collect():
        assert t == np.cumsum(v).tolist()


def test_word_hashes_follow_words():
    assert len(word_hashes(None)) == len(word_hashes(" \n")) == 0
    text = LONG + " " + LONG
    h = word_hashes(text)
    assert len(h) == 6000 and (h[:3000] == h[3000:]).all() and len(set(h.tolist())) == len(set(text.split()))
    big = "ab " * 900_000  # longer than a chunk
    assert len(word_hashes(big)) == 900_000 and len(set(word_hashes(big).tolist())) == 1
    assert set_key(shingle_set("a b c d e f")) != set_key(shingle_set("a b c d e g"))


# ---- 1 mixing --------------------------------------------------------------------------------------------------------------

def test_mixing(spark, sf_dir, corpus):
    rows = queries()["op1_mix_sources"](spark, sf_dir).collect()
    again = queries()["op1_mix_sources"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(corpus)
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = brute.targets(size)
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= max(20, 0.03 * target[s], 0.5 * largest[s])


def test_balance_solves_the_dual(spark):
    rows = [("a", z, 3 + z % 5) for z in range(1, 400, 7)] + [("b", z, 2) for z in (1, 10, 5000)] + [("c", 0, 5)] + [(None, 4, 10)] + [("d", z, 1) for z in (10, 20)]
    cells = spark.createDataFrame(rows, "source string, size long, n long")
    size = defaultdict(int)
    for s, z, n in rows:
        size[s] += z * n
    aims = {"a": 0.3 * size["a"], "b": 2.9 * size["b"], "c": 0.0, None: 3.0 * size[None], "d": 1.0 * size["d"]}
    targets = spark.createDataFrame([(s, size[s], float(t)) for s, t in aims.items()], "source string, source_size long, target double")
    got = {r["source"]: (r["scale"], r["lam"]) for r in mixing.balance(cells, targets).collect()}
    for s in aims:
        mine = [(z, n) for x, z, n in rows if x == s]
        scale = max(1e-9, sum(z * n for z, n in mine) / sum(n for _, n in mine))
        mass = lambda lam: sum(n * z * min(3.0, np.exp(min(lam * z / scale, 2))) for z, n in mine)
        assert got[s][0] == pytest.approx(scale) and mass(got[s][1]) == pytest.approx(aims[s], rel=1e-6)
    low, high = -50.0, 0.0  # plain bisection for one of them
    z_n = [(z, n) for x, z, n in rows if x == "a"]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(n * z * np.exp(mid * z / got["a"][0]) for z, n in z_n) > aims["a"] else (mid, high)
    assert got["a"][1] == pytest.approx(low, abs=1e-6) and got["d"][1] == pytest.approx(0, abs=1e-8)


def test_mixing_caps_and_odd_rows(spark, odd, none):
    d = spark.createDataFrame([(i, "w " * n, "en", s, 1) for i, (n, s) in enumerate([(1000, "b")] + [(1, "a")] * 5 + [(10, None)] * 4)], SCHEMA)
    plan = mixing.mixing_plan(mixing.document_sizes(d))
    got = {r["s"]: r["target"] for r in plan.collect()}
    assert got == pytest.approx(brute.targets({"a": 5, "b": 1000, None: 40}))
    assert got["a"] == 15 and {r["s"]: r["whole"] for r in plan.collect()}["a"] == 3
    out = mixing.mix_documents(odd)
    assert out.columns == odd.columns and mixing.mix_documents(none).count() == 0
    counts = {(r["doc_id"], r["text"]): r["n"] for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert counts[(2, None)] == 1 and counts[(3, "")] == 1


# ---- 2 personal data -------------------------------------------------------------------------------------------------------

TRICKY = [
    "a@b.c%x@e.f +1 (743) 555-3824 4785380592391139", "1.2.3.4.5.6.7.8 256.1.1.1 999", "mail x.y+z@sub.example.com, card 4111-1111-1111-1111", "+", "+1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
    "é漢 a@b.cc 漢 10.0.0.1", "token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\"", "9" * 6000 + " a@b.c", "a" * 60_000, "0000000010.1.1.1", None, "", "@b.c a@b a@b.", "12 " * 2000,
]


def test_pii_base_spans(spark):
    d = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    kinds = pii.KINDS
    for r in pii.find_pii(d, keep=("doc_id", "text")).collect():
        got = [(s["start"], s["kind"], s["end"], kinds[s["kind"]]) for s in r["_spans"] if s["base"]]
        assert got == brute.base_spans(r["text"]), r["doc_id"]


def test_pii_query(spark, sf_dir, corpus):
    rows = {r["doc_id"]: r for r in queries()["op2_pii_boosting"](spark, sf_dir).collect()}
    for d, t in corpus:
        assert rows[d]["base_sha256"] == brute.base_hash(t)
        assert rows[d]["n_email"] + rows[d]["n_ip"] + rows[d]["n_card"] + rows[d]["n_phone"] == len(brute.base_spans(t))


def test_pii_added_without_cue(spark):
    r = np.random.default_rng(4)
    hexed = lambda: "".join(r.choice(list("0123456789abcdef"), 40))
    other = lambda: "-".join(["part", "of", "a", "long", "name", str(r.integers(10, 99)), "x"])
    docs = [(i, f'some text {i} token = "{hexed()}" and {other()} more words {r.integers(10**6, 10**7)}') for i in range(200)]
    alone = f'no word before "{hexed()}" tells'
    docs += [(1000, alone), (1001, f"an {other()} here"), (1002, "4785380592391138 fails its check"), (1003, None), (1003, "")]
    got = {x["doc_id"]: x["_spans"] for x in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string"), keep=("doc_id", "text")).collect()}
    kinds = lambda d: [(pii.KINDS[s["kind"]], s["start"], s["end"], s["base"]) for s in got[d]]
    assert kinds(1000) == [("secret", 16, 56, False)] and kinds(1001) == kinds(1002) == kinds(1003) == []
    assert sum([k for k, *_ in kinds(i)] == ["secret"] for i in range(200)) >= 195 and {k for i in range(200) for k, *_ in kinds(i)} == {"secret"}


def test_pii_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    d = docs.select(F.lit(1).alias("row"), F.coalesce("text", F.lit("")).alias("text"), (F.xxhash64("text") % 2 != 0).cast("int").alias("half"))
    model = pii.fit(pii.candidates(d, F.col("text")))
    n, marked, selected, precision, recall = model.report["secret"]
    assert n >= selected >= 1 and marked >= 1 and precision >= 0.9 and recall >= 0.9
    assert model.report["ip6"][2] == 0 and model.thresholds[6] == float("inf") and len(model.trees) == 24
    assert pii.fit(pii.candidates(d.limit(0), F.col("text"))).trees == []


def test_redaction(spark, odd, none):
    d = spark.createDataFrame([(1, "write to a.b@c.de or 10.0.0.1 now"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact_documents(d).collect()}
    assert got == {1: "write to [EMAIL] or [IP] now", 2: "nothing here", 3: None}
    assert pii.redact_documents(odd).count() == len(ODD) and pii.redact_documents(none).columns == none.columns and pii.redact_documents(none).count() == 0


# ---- 3 rules ---------------------------------------------------------------------------------------------------------------

def test_rules(spark, sf_dir, corpus, odd, none):
    rows = {r["doc_id"]: r for r in queries()["op3_quality_rules"](spark, sf_dir).collect()}
    for d, t in corpus:
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(t)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [(rows[d]["kept"], q) for d, q in labels.items() if not rows[d]["base_failed"]]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.95
    good = spark.createDataFrame([(5,), (5,), (99,), (None,)], "doc_id long")
    for d in (odd, none):
        out = quality_rules.quality_rules(d, good)
        assert set(d.columns) <= set(out.columns)
        for r in out.collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(r["text"])
    assert {r["score"] for r in quality_rules.quality_rules(odd, good.limit(0)).collect()} == {0.0}
    assert quality_rules.quality_rules(odd, good).filter("kept").count() <= 2  # a filter above must not change the work below


def test_target_counts_cover_all_good_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    one, two = quality_rules.fit_ratio(docs, good), quality_rules.fit_ratio(docs, good, broadcast_ids=3)
    assert one == two and any(one)
    d, marks = docs.select(F.col("doc_id").alias("id")), good.select(F.col("doc_id").alias("good_id")).distinct()
    passed = {r["id"] for r in maybe_among_ids(d, "id", marks, "good_id").filter("maybe").collect()}
    assert passed == {r["good_id"] for r in marks.collect()} & {r["id"] for r in d.collect()}  # the filter is nearly empty here


# ---- 4 near duplicates -----------------------------------------------------------------------------------------------------

def test_near_duplicates(spark, sf_dir, corpus):
    rows = {r["doc_id"]: r for r in queries()["op4_chosen_path_join"](spark, sf_dir).collect()}
    for (d, _), (cls, links) in zip(corpus, brute.near(corpus), strict=True):
        assert (rows[d]["class_id"], rows[d]["n_links"]) == (cls, links)


def test_large_group_of_near_copies(spark):
    r = np.random.default_rng(1)
    base = [f"t{i}" for i in range(150)]
    docs = []
    for i in range(700):  # more than a leaf and more than a block of verification
        w = list(base)
        if i % 3:
            w[int(r.integers(150))] = f"x{i}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join(f"q{i}_{k}" for k in range(30)) + " " + " ".join(base[:40])) for i in range(300)]
    got = {x["doc_id"]: x for x in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for (d, _), (cls, links) in zip(docs, brute.near(docs), strict=True):
        assert (got[d]["class_id"], got[d]["n_links"]) == (cls, links), d


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = sorted([(str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.near_duplicates(odd).collect()])
    assert got == sorted([("1", "1", 1), ("1", "1", 1), ("2", "2", 0), ("3", "3", 0), ("4", "4", 0), ("5", "5", 1), ("6", "5", 1), ("None", "None", 0), ("7", "7", 0), ("8", "8", 0)])
    one = jaccard_join.keep_one_of_each(odd)
    assert one.columns == odd.columns and one.count() == len(ODD) - 2
    assert jaccard_join.near_duplicates(none).count() == 0 and jaccard_join.keep_one_of_each(none).count() == 0
    plain = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.keep_one_of_each(plain).collect()) == [1, 3]


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.995) == 12 and jaccard_join.runs_for(0.5) < jaccard_join.runs_for(0.9)


# ---- 5 passages ------------------------------------------------------------------------------------------------------------

def test_passages(spark, sf_dir, corpus):
    rows = queries()["op5_passage_dedup"](spark, sf_dir).collect()
    found = {r["doc_id"] for r in rows}
    long = brute.long_repeats(corpus, 51)
    assert len(long - found) <= 0.01 * len(long)
    inside = {d for d, t in corpus if any(n > 1 for n in Counter(tuple(w[i : i + 12]) for w in [brute.words(t)] for i in range(len(w) - 11)).values())}
    assert found <= brute.long_repeats(corpus, 12) | inside  # a passage may repeat in its own document


def test_passages_inside_lines(spark, odd, none):
    r = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"v{x}" for x in r.integers(0, 10**9, n))
    passage = fresh(56)
    docs = [(i, f"{fresh(40)} {passage} {fresh(40)}" if i % 2 else fresh(120)) for i in range(40)]
    got = passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in got} == {i for i in range(40) if i % 2}
    assert sorted(x["doc_id"] for x in got if not x["removed"]) == [1]
    cut = {x["doc_id"]: x["text"] for x in passage_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    whole = dict(docs)
    assert all(cut[i] == whole[i] for i in range(40) if i % 2 == 0 or i == 1)
    assert all(len(brute.words(cut[i])) <= 136 - 24 and brute.words(cut[i])[:40] == brute.words(whole[i])[:40] for i in range(3, 40, 2))
    at = [(x["start_word"] >= 40 and x["end_word"] <= 96) for x in got]
    assert all(at)
    assert {x["doc_id"] for x in passage_dedup.repeated_passages(odd).collect()} == {5, 6} and passage_dedup.repeated_passages(none).count() == 0


def test_near_copies_of_paragraphs(spark):
    r = np.random.default_rng(5)
    fresh = lambda n: [f"v{x}" for x in r.integers(0, 10**9, n)]
    docs, odd_ids = [], range(1, 60, 2)
    for i in odd_ids:  # a line of 60 words, then its copy with another word in the middle: similarity 0.84
        first = fresh(60)
        for k, p in enumerate((first, first[:30] + ["other"] + first[31:])):
            docs.append((100 * i + k, "\n".join([" ".join(fresh(50)), " ".join(p), " ".join(fresh(50))])))
    for i in odd_ids:  # the same inside a line, 100 words with two changes: similarity 0.81
        first = fresh(100)
        for k, p in enumerate((first, first[:33] + ["other"] + first[34:66] + ["another"] + first[67:])):
            docs.append((100 * i + 10 + k, " ".join([*fresh(50), *p, *fresh(50)])))
    got = passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {x["doc_id"] for x in got if x["removed"]}
    beyond = [max(50 - x["start_word"], x["end_word"] - (150 if x["doc_id"] % 100 >= 10 else 110)) for x in got]
    assert max(beyond) <= 5  # what similarity 0.8 lets a long piece hold besides
    assert sum(100 * i + 1 in found for i in odd_ids) >= 28 and sum(100 * i + 11 in found for i in odd_ids) >= 28
    assert not any(d % 10 == 0 for d in found)


def test_bits_lose_no_similar_pair():
    """Sets of similarity 0.8 or more pass, whichever bits differ, the sign bit included."""
    r = np.random.default_rng(3)
    for _ in range(500):
        shared, extra = r.integers(0, 2**63, 17, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, 4, dtype=np.uint64) * np.uint64(2)
        sets = [set(np.concatenate([shared, part]).tolist()) for part in (extra[:2], extra[2:])]
        bits = [int(np.bitwise_or.reduce(np.array([1 << (x >> 58) for x in s], np.uint64)).view(np.int64)) for s in sets]
        assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
        assert passage_dedup.may_match([len(s) for s in sets], bits).all()
    assert not passage_dedup.may_match([5, 5], [0b11111, -(2**63) + 0b111100000]).any()


def test_bands_of_many_paragraphs(spark):
    r = np.random.default_rng(8)
    p = [f"v{x}" for x in r.integers(0, 10**9, 90)]
    docs = [(i, " ".join(p[:2 * i] + [f"other{i}"] + p[2 * i + 1:])) for i in range(45)]  # each differs from each other in two words
    d = spark.createDataFrame(docs, "doc_id long, text string")
    bands = passage_dedup.bands_for()
    found = passage_dedup.materialize(passage_dedup.shared_paragraphs(d, bands), "paragraphs")
    groups = []
    for block in (4, 256):
        rows = passage_dedup.connected_components(passage_dedup.verified_edges(d, found, bands, block)).collect()
        groups.append({x["node"]: x["component"] for x in rows})
    assert groups[0] == groups[1] and len(groups[0]) >= 45


def test_bands_alike_by_their_place_alone(spark):
    """Different bands that fall on one of the 2**27 places of the filter name no paragraph: here no word stands twice."""
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(3000)]
    found = passage_dedup.shared_paragraphs(spark.createDataFrame(docs, "doc_id long, text string"), 2)
    assert found.filter("level < 2").count() == 0  # neighbouring windows of a text may share a band


def test_pairs_of_a_band():
    """Two paragraphs alone are told as they are told among others."""
    r = np.random.default_rng(4)
    for k in range(60):
        base = np.unique(r.integers(0, 2**32, 40, dtype=np.uint32) | np.uint32(1))
        sets = [np.unique(np.concatenate([r.permutation(base)[: 40 - k % 6], r.integers(0, 2**32, k % 4, dtype=np.uint32) | np.uint32(1)])) for _ in range(2)]
        ends = [np.array([base[0] if k % 2 else 0, base[1] if k % 3 == 0 else 0], np.uint32) for _ in range(2)]
        held = [a.tobytes() + b.tobytes() for a, b in zip(ends, sets, strict=True)]
        far = np.zeros(2, np.uint32).tobytes() + np.array([3], np.uint32).tobytes()
        assert passage_dedup.similar_groups(held).tolist() == passage_dedup.similar_groups([*held, far]).tolist()[:2]


def test_many_long_paragraphs_of_a_band(monkeypatch):
    """Long paragraphs fill 64 bits, so of many that share a band wider sets tell which can be similar; none that is similar is lost."""
    r = np.random.default_rng(9)
    base = [r.integers(0, 2**32, 400, dtype=np.uint32) | np.uint32(1) for _ in range(50)]
    sets = [np.unique(np.concatenate([base[k % 50][: 400 - k % 7 * 8], r.integers(0, 2**32, k % 5 * 8, dtype=np.uint32) | np.uint32(1)])) for k in range(300)]
    held = [np.zeros(2, np.uint32).tobytes() + x.tobytes() for x in sets]
    compared = []
    monkeypatch.setattr(passage_dedup, "frozenset", lambda x: compared.append(1) or Counted(x), raising=False)

    class Counted(set):
        def __and__(self, other):
            compared.append(2)
            return set.__and__(self, other)

    told = passage_dedup.similar_groups(held).tolist()
    assert compared.count(2) < 300 * 30  # of 45,000 pairs; all of equal sizes without the wider sets
    plain, label = [set(x.tolist()) for x in sets], list(range(300))
    for i in range(300):
        for j in range(i):
            if label[i] != label[j] and len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert told == label


def test_groups_of_a_band():
    """Components of a band against plain sets: similarity 0.8 or more, and each one's ends in the other."""
    r = np.random.default_rng(12)
    for n in (2, 3, 40):
        base = np.unique(r.integers(0, 2**32, 60, dtype=np.uint32) | np.uint32(1))
        sets = [np.unique(np.concatenate([r.permutation(base)[: 60 - k % 9], r.integers(0, 2**32, k % 5, dtype=np.uint32) | np.uint32(1)])) for k in range(n)]
        ends = [np.array([base[k % 3] if k % 2 else 0, 0], np.uint32) for k in range(n)]
        plain, e = [set(x.tolist()) for x in sets], [{y for y in x.tolist() if y} for x in ends]
        label = list(range(n))
        for i in range(n):
            for j in range(i):
                if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]) and e[i] <= plain[j] and e[j] <= plain[i]:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        assert passage_dedup.similar_groups([a.tobytes() + b.tobytes() for a, b in zip(ends, sets, strict=True)]).tolist() == label
    many = r.integers(0, 2**63, 700).tolist()
    want = [sum((a ^ b).bit_count() <= 0.25 * 96 + 1e-9 for b in many) > 1 for a in many]
    assert passage_dedup.may_match([96] * 700, many).tolist() == passage_dedup.may_match([96] * 700, many, 16).tolist() == want


def test_recall_of_edited_copies(spark):
    """200 passages each with one changed word in the copy: 60 words as a line of their own, and 100 and 60 words inside a line.

    60 words inside a line leave few places for a window of 40 words with its margins: there recall is lower.
    """
    r = np.random.default_rng(21)
    fresh = lambda n: [f"v{x}" for x in r.integers(0, 10**9, n)]
    docs = []
    for i in range(200):
        for k, (n, gap) in enumerate([(60, "\n"), (100, " "), (60, " ")]):
            p, at = fresh(n), int(r.integers(0, n))
            for copy, text in enumerate((p, p[:at] + fresh(1) + p[at + 1 :])):
                docs.append((6 * i + 2 * k + copy, gap.join(" ".join(x) for x in (fresh(30), text, fresh(30)))))
    found = {x["doc_id"] for x in passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    recall = [sum({6 * i + 2 * k, 6 * i + 2 * k + 1} <= found for i in range(200)) / 200 for k in range(3)]
    print("recall: line of 60, 100 and 60 inside a line", recall)
    assert recall[0] >= 0.95 and recall[1] >= 0.95 and recall[2] >= 0.8


def test_passages_repeated_in_one_document(spark):
    r = np.random.default_rng(6)
    fresh = lambda n: " ".join(f"v{x}" for x in r.integers(0, 10**9, n))
    p = fresh(60)
    docs = [(1, f"{fresh(40)} {p} {fresh(40)} {p} {fresh(40)}"), (2, fresh(300)), (None, fresh(50))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["start_word"], x["end_word"], x["removed"]) for x in passage_dedup.repeated_passages(d).collect() if x["doc_id"] == 1)
    assert [x[2] for x in got] == [False, True] and 40 <= got[0][0] < got[0][1] <= 100 and 140 <= got[1][0] < got[1][1] <= 200
    cut = {x["doc_id"]: x["text"] for x in passage_dedup.remove_repeats(d).collect()}
    assert len(brute.words(cut[1])) <= 240 - 24 and brute.words(cut[1])[:140] == brute.words(docs[0][1])[:140]
    assert cut[2] == docs[1][1] and cut[None] == docs[2][1]
    twice = [(1, docs[0][1], 0), (1, "short and different", 1)]  # one id, two texts
    out = passage_dedup.remove_repeats(spark.createDataFrame(twice, "doc_id long, text string, _id int"))
    assert out.columns == ["doc_id", "text", "_id"] and sorted(r["text"] for r in out.collect()) == sorted(t for _, t, _ in twice)


# ---- 6 shards --------------------------------------------------------------------------------------------------------------

def check_shards(rows, n, spread):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["shard_bytes"] if "shard_bytes" in r else r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(size) <= set(range(n))
    assert max(size.values()) - min(size.values()) <= spread


def test_shards(spark, sf_dir, corpus, odd, none):
    rows = [r.asDict() for r in queries()["op6_histogram_shards"](spark, sf_dir).collect()]
    text = dict(corpus)
    assert len(rows) == len(corpus)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    check_shards(rows, 16, 2 * max(r["size"] for r in rows))
    out = sharding.shard_documents(odd, 4)
    check_shards([r.asDict() for r in out.collect()], 4, 200_000)
    assert sharding.shard_documents(none, 4).count() == 0


def test_shards_of_one_hot_text(spark, tmp_path):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    check_shards([r.asDict() for r in sharding.shard_documents(d, 16).collect()], 16, 60)
    sharding.write_shards(d, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 4


def test_shards_of_equal_rows(spark):
    d = spark.range(2490).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2000, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("x").alias("slot"))
    out = sharding.shard_documents(d, 16)
    rows = [r.asDict() for r in out.collect()]
    assert len(rows) == 2490 and sorted(out.columns) == sorted(["doc_id", "text", "shard_bytes", "text_crc32", "shard", "slot"])
    check_shards(rows, 16, 28)  # two rows


# ---- 7 WARC ----------------------------------------------------------------------------------------------------------------

HTML = """<html><head><title>A &amp; B</title><style>p{x}</style><script>var t="</p>";</script></head>
<body><!-- no --><p title="a>b">One&nbsp;two<br>three &#233;&#x6F22;</p><a href="/x?a=1&amp;b=2">go</a></body></html>"""


def test_warc(spark, sf_dir, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", HTML), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derive(warc.page_responses(pages)).collect()
    assert len(rows) == 6
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    assert by[(1, "conversion")]["block"] == "A & B\nOne two\nthree é漢\ngo"
    meta = json.loads(by[(1, "metadata")]["block"])
    assert meta["title"] == "A & B" and meta["links"] == ["/x?a=1&b=2"] and meta["bytes"] == len(HTML.encode())
    assert by[(2, "conversion")]["block"] == "" and by[(2, "conversion")]["content_length"] == 0
    response = warc.page_responses(pages).filter("page_id = 1").first()
    for kind in ("metadata", "conversion"):
        r = by[(1, kind)]
        assert (r["refers_to"], r["target_uri"], r["date"], r["source_headers"]) == (response["record_id"], "http://a/", response["date"], response["http_headers"])
        import base64
        import hashlib

        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
        assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    d = warc.derive(warc.page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    warc.write_warc(d.coalesce(2), str(tmp_path / "w"), "none")
    back = {r["headers"]["warc-record-id"]: (r["block"], r["headers"]["warc-refers-to"], r["complete"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    want = {r["record_id"]: (r["block"], r["refers_to"], True) for r in d.collect()}
    assert back == want
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


def test_warc_gzip_members(spark, tmp_path):
    import zlib as z

    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>caf\u00e9 {i}</p>") for i in range(5)] + [(9, None, None)], "page_id long, url string, html string")
    d = warc.derive(warc.page_responses(pages))
    path = str(tmp_path / "gz")
    warc.write_warc(d.repartition(2), path)
    seen = 0
    for f in (tmp_path / "gz").glob("part-*.warc.gz"):
        data = f.read_bytes()
        while data:  # a member at a time
            member = z.decompressobj(31)
            text = member.decompress(data).decode()
            assert member.eof and text.startswith("WARC/1.0\r\n") and text.count("WARC/1.0\r\n") == 1 and text.endswith("\r\n\r\n")
            data, seen = member.unused_data, seen + 1
    assert seen == 12 and sorted(p.name[0] for p in (tmp_path / "gz").iterdir()) == ["_", "p", "p"]
    back = warc.read_warc(spark, path).withColumn("head", warc.source_headers_of(F.col("headers"))).collect()
    want = {r["record_id"]: (r["block"], r["source_headers"]) for r in d.collect()}
    assert {r["headers"]["warc-record-id"]: (r["block"], r["head"]) for r in back} == want and all(h.endswith("\r\n") for _, h in want.values())


def test_markup_as_the_standard_parser(spark, sf_dir):
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r["html"]]
    r = np.random.default_rng(8)
    bits = ["word ", "two words", "<p>", "</p>", "<b class='x>y'>", "</b>", "<br/>", "<!-- a <p> -->", "<script>if (a<b) {'</p>'}</script>", "<a href=\"/q?a=1&amp;b=2\" title='t'>", "</a>", "&eacute;&#233;&nbsp;", "\n", "<li>", "a < b", "<STYLE>p{}</STYLE >", "<td data-href='no'>"]
    pages += ["<title>T &amp; U</title>" + "".join(bits[k] for k in r.integers(0, len(bits), 40)) for _ in range(300)]
    for page in pages:
        want = brute.Page(page)
        assert warc.read_markup(page) == (want.text, want.title, want.links), page


def test_unclosed_markup_takes_linear_time():
    import time

    for bit in ("<!-- ", "<", "<script>", "<a href=\"", "<p title='", "<p '\"", "<title>", "<b>'", "<i \">"):
        start = time.time()
        text, title, links = warc.read_markup("before " + bit * (2_000_000 // len(bit)))
        assert time.time() - start < 10 and text.startswith("before"), bit
    assert warc.read_markup("a<!-- b") == ("a", "", []) and warc.read_markup("a<script>b") == ("a", "", []) and warc.read_markup("a<b c") == ("a<b c", "", [])
    assert warc.read_markup("") == ("", "", []) and warc.read_markup("x<p a=\"1>2</p>3") == ("x\n2\n3", "", [])


def test_version_line_inside_a_block(spark, tmp_path):
    blocks = ["plain", "one WARC/1.0\r\ntwo\r\n\r\nthree", "WARC/1.0\r\nWARC/1.0\r\n", "", "last WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc é"]
    d = spark.createDataFrame([(f"r{k}", b, len(b.encode())) for k, b in enumerate(blocks)], "record_id string, block string, content_length long").coalesce(1)
    warc.write_warc(d, str(tmp_path / "v"), "none")
    got = {r["headers"]["warc-record-id"]: (r["block"], r["complete"]) for r in warc.read_warc(spark, str(tmp_path / "v")).collect()}
    assert got == {f"r{k}": (b, True) for k, b in enumerate(blocks)}


# ---- 8 lines ---------------------------------------------------------------------------------------------------------------

LINES = [
    (1, "a b c\nd e f\ng h i\nend here"), (2, "x y\na b c\nd e f\n\ng h i\ny z"), (3, "p p\n" * 12), (4, "a b c\nd e f"), (5, None), (6, "one line that holds eight words or more"),
    (7, "new\none line that holds eight words or more\nother"), (8, "A b c\nB d e\n" * 6), (8, "quite another text under the same id as that above\nk l m n"), (8, "q r\nk l m n"),
    (9, "one line that holds eight words or more"), (9, "one line that holds eight words or more"), (None, "new\none line that holds eight words or more"),
]


def test_lines(spark, sf_dir, corpus, odd, none):
    want = brute.repeated_lines(corpus)
    got = {r["doc_id"]: r["runs"] for r in queries()["op8_winnowed_lines"](spark, sf_dir).collect()}
    assert [got[d] for d, _ in corpus] == [",".join(f"{a}-{b}" for a, b in want.get(k, [])) for k in range(len(corpus))]
    d = spark.createDataFrame([(i, t) for i, t in LINES if i != 8], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: LINES[0][1], 2: "x y\n\ny z", 3: "p p\n" * 4, 4: "a b c\nd e f", 5: None, 6: "", 7: "new\nother", 9: "", None: LINES[-1][1]}
    assert line_dedup.dedup_lines(odd).columns == odd.columns and line_dedup.dedup_lines(odd).count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("pairwise", [0, 1, 64])
def test_line_runs_of_any_neighbourhood(spark, monkeypatch, pairwise):
    monkeypatch.setattr(line_dedup, "PAIRWISE", pairwise)
    r = np.random.default_rng(2)
    words_ = ["a", "b", "a b", "b a c", "long line of eight words a b c", "", "c"]
    docs = [(i, "\n".join(words_[k] for k in r.integers(0, len(words_), 25))) for i in range(60)]
    got = defaultdict(list)
    for x in line_dedup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[x["doc_id"]].append((x["start_line"], x["end_line"]))
        assert x["source_doc"] < x["doc_id"] or x["source_line"] < x["start_line"]
    assert {k: sorted(v) for k, v in got.items()} == brute.repeated_lines(docs)


def test_lines_of_rows_that_share_an_id(spark):
    d = spark.createDataFrame([x for x in LINES if x[0] == 8], "doc_id long, text string")
    first, other, third = (x[1] for x in LINES if x[0] == 8)
    assert sorted(r["text"] for r in line_dedup.dedup_lines(d).collect()) == sorted(["A b c\nB d e\n" * 2, other, third])
    long = spark.createDataFrame([(k, "\n".join(f"line {i} of a text that is long" for i in range(30_000))) for k in range(2)], "doc_id int, text string")
    assert sorted(len(r["text"]) > 0 for r in line_dedup.dedup_lines(long).collect()) == [False, True]


# ---- 9 classifier ----------------------------------------------------------------------------------------------------------

def test_classifier(spark, sf_dir, odd, none):
    rows = {r["doc_id"]: r for r in queries()["op9_attention_mil"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in rows.items())
    unseen = [(rows[d]["predicted"], q) for d, q in labels.items() if rows[d]["held_out"]]
    assert np.mean([p == q for p, q in unseen]) > 0.9
    blocks = np.concatenate(list(quality_classifier.encode(LONG)))
    assert blocks.shape == (47, quality_classifier.WIDTH) and quality_classifier.held_out is not None
    for marks in ([(1, 1), (5, 0), (6, None), (7, 1), (7, 0)], [(1, 1)], []):
        good = spark.createDataFrame(marks, "doc_id long, quality int")
        model = quality_classifier.fit(odd, good)
        scored = quality_classifier.score_documents(odd, model, out="s").collect()
        assert len(scored) == len(ODD) and all(0 <= r["s"] <= 1 for r in scored)
    assert quality_classifier.keep_good(none, good).count() == 0
    for t in (LONG, "", "a few words é"):
        assert quality_classifier.score_text(model, t) == pytest.approx(brute.mil_score(model, np.concatenate(list(quality_classifier.encode(t)))), rel=1e-4)
    again = quality_classifier.fit(odd, spark.createDataFrame([(1, 1), (5, 0), (6, 1)], "doc_id long, quality int"), sample_passages=50)
    assert all(np.isfinite(v).all() for v in again.values())  # one of the two long texts does not fit
    parts = quality_classifier.passage_weights(odd, model).groupBy("doc_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()
    assert all(r["w"] == pytest.approx(2 if r["doc_id"] == 1 else 1) for r in parts) and {r["doc_id"]: r["n"] for r in parts}[5] == 47


# ---- 10 leaks --------------------------------------------------------------------------------------------------------------

def test_leaks(spark, sf_dir, corpus, odd, none):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(brute.words(t))
    want = {(d, i) for d, t in corpus for i, x in items if len(brute.words(x)) >= 8 and flat(x) in flat(t)}
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op10_template_leaks"](spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 2


def test_changed_parameters(spark, odd, none):
    q = "A train from Boston to Albany travels 120 km in 3 hours and then waits 120 minutes before it goes back to Boston at half the speed . How long is the way ?"
    moved = q.replace("Boston", "Lyon").replace("Albany", "Paris").replace("120", "250").replace(" 3 ", " 5 ")
    mixed = q.replace("120 km", "250 km").replace("120 minutes", "999 minutes").replace("Boston to", "Lyon to").replace("to Boston", "to Nice").replace("A train", "One train")
    docs = spark.createDataFrame([(1, "Some words . " + q + " More words ."), (2, "Here : " + moved), (3, "nothing of the kind " * 10), (4, mixed)], "doc_id long, text string")
    items = spark.createDataFrame([(9, q), (8, "too short"), (7, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(docs, items).collect()}
    assert set(got) == {1, 2} and got[1]["verbatim"] and not got[2]["verbatim"] and got[2]["agree"] == 1
    assert [r["doc_id"] for r in decontamination.drop_leaks(docs, items).orderBy("doc_id").collect()] == [3, 4]
    kept = decontamination.drop_leaks(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and decontamination.drop_leaks(none, items).count() == 0
    assert decontamination.drop_leaks(odd, items.limit(0)).count() == len(ODD)


def test_slots_map_one_to_one(spark):
    q = "Take {} pears and {} plums from the basket on the table and put {} nuts in , how many pieces of fruit are there now in all ?"
    docs = [(1, q.format(3, 5, 9)), (2, q.format(1, 2, 3)), (3, q.format(7, 7, 7)), (4, q.format(9, 5, 3)), (5, "Say PI !"), (6, "say pi or not"), (7, "what is 12 + 5 - 3 * 8 + 2 ?"), (8, "What is 7 + 7 - 7 * 7 + 7 ?")]
    items = spark.createDataFrame([(1, q.format(3, 5, 9)), (2, "say pi"), (3, "What is 12 + 5 - 3 * 8 + 2 ?"), (4, "")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(d, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 1), (5, 2), (7, 3)}
    assert got[(1, 1)]["verbatim"] and not got[(2, 1)]["verbatim"] and got[(2, 1)]["n_slots"] >= 3 and got[(2, 1)]["agree"] == 1
    assert [r["doc_id"] for r in decontamination.drop_leaks(d, items).orderBy("doc_id").collect()] == [3, 6, 8]


def test_without_ids(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (3, "e")], "id int, gone string")
    for ids, kept in (([1, 3], ["b", "c"]), ([None], ["a", "b", "d", "e"]), ([], ["a", "b", "c", "d", "e"])):
        gone = spark.createDataFrame([(i,) for i in ids], "k int")
        for most in (0, 10):
            out = without_ids(d, gone, "id", "k", most)
            assert out.columns == d.columns and sorted(r["gone"] for r in out.collect()) == kept


def test_leaks_in_other_case(spark):
    q = "Anna Berg and Otto Lind walk from Graz to Linz . Then Anna Berg asks Otto Lind how far Graz is from Wels , and Otto Lind says twice as far as Linz ."
    short = "Which River Runs Through Linz ?"
    docs = [(1, "some words before . " + q.upper() + " AND MORE"), (2, q.lower()), (3, "he asked : WHICH RIVER RUNS THROUGH LINZ ? nobody knew"), (4, "which river runs through Graz ? " * 3), (5, q)]
    items = spark.createDataFrame([(9, q), (8, short)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(d, items).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 9), (3, 8)}
    assert all(r["verbatim"] and r["coverage"] == 1 and r["n_matched"] == r["n_windows"] for r in got.values())
    assert [r["doc_id"] for r in decontamination.drop_leaks(d, items).collect()] == [4]


def test_leaks_in_rows_that_share_an_id(spark):
    q = "Anna Berg and Otto Lind walk from Graz to Linz . Then Anna Berg asks Otto Lind how far Graz is from Wels , and Otto Lind says twice as far as Linz ."
    docs = [(1, "first " + q), (1, "zzz another text of the same id that is clean and greater"), (1, ""), (2, "nothing of the kind here at all , only words"), (None, q), (None, "zz"), (3, q), (3, q)]
    items = spark.createDataFrame([(9, q), (8, "two words")], "item_id long, text string")
    d = spark.createDataFrame([*docs, (4, "Two , words !")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(d, items).collect()}
    assert set(got) == {(1, 9), (None, 9), (3, 9), (4, 8)} and all(r["verbatim"] and r["coverage"] == 1 for r in got.values())
    assert [r["doc_id"] for r in decontamination.drop_leaks(d, items).collect()] == [2]


def test_phrases_that_many_items_share(spark):
    head = "Please answer the following question about the text above in one short sentence and give a reason for it : "
    r = np.random.default_rng(12)
    fresh = lambda n: " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(n))
    own = [fresh(30) for _ in range(60)]
    items = spark.createDataFrame([(i, head + t) for i, t in enumerate(own)], "item_id long, text string")
    docs = [(i, f"before {head}{own[i]} after") for i in range(5)] + [(100 + i, head + fresh(40)) for i in range(50)]
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(i, i) for i in range(5)}


# ---- all -------------------------------------------------------------------------------------------------------------------

def test_sql(spark, sf_dir):
    import duckdb

    for name, sql in oracle_sql().items():
        con = duckdb.connect()
        for table in ("documents", "embeddings", "labels"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        got, want = queries()[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        key = sorted(got.columns)
        assert sorted(map(tuple, got[key].astype(str).values)) == sorted(map(tuple, want[key].astype(str).values))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf_dir).cache()
        if k < 4:
            assert out.columns == docs.columns, name
        if k == 1:
            rows = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert all(links == 0 for _, links in brute.near(rows))
            assert len(rows) == len({c for c, _ in brute.near([(r["doc_id"], r["text"]) for r in kept.collect()])})
        if k == 2:
            assert decontamination.find_leaks(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        assert out.count() > 0.5 * kept.count()
        kept = out
    check_shards([r.asDict() for r in kept.collect()], 16, 60_000)
    assert corpus_pipeline.run(spark, sf_dir).columns == kept.columns


def test_pipeline_stages_on_odd_tables(spark, sf_dir, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
            rows = out.collect()
            assert len(rows) <= 3 * len(ODD) and (docs is odd or not rows), name
            if name in ("n-gram Jaccard join", "benchmark decontamination", "sharding") and docs is odd:
                assert len(rows) == {"n-gram Jaccard join": len(ODD) - 2}.get(name, len(ODD)), name
                assert all(r["row"] == 0 and r["_gone"] == 0 and r["key"] == 1 for r in rows), name


def test_scratch_tables_go(spark, odd):
    import os

    from kinloom.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    line_dedup.repeated_runs(odd).collect()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and "line-runs" in left.pop()  # the result itself

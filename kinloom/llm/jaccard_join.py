"""Operator 4: n-gram Jaccard self-join by chosen paths.

Sets of five-word shingles are split recursively: at a node a set of n shingles follows each shingle whose hash, keyed by the
path so far, falls below 1 / (0.8 n), so that two sets of similarity 0.8 share a child with probability 0.63 or more.  Small
buckets are searched by brute force on minhash sketches; large ones are split again, down to a fixed depth, below which they
are searched in pairs of blocks.  Independent runs are repeated until the target recall.  Sets that a sketch links form
candidate groups, and every pair inside a group is verified on the full shingle sets, so each set is fetched once however
many buckets it shared.  Results are counts and classes: pairs are never written out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, load, materialize, maybe_among, packed, release, scratch, small_batches, unpacked, without_rows
from .shingles import Forest, SKETCH, mix, set_key, shingle_set, sketch, stream_groups

THRESHOLD = 0.8
DEPTH = 3
RECALL = 0.995
LEAF = 200
BLOCK = 1024
#: A set pair at the threshold agrees in at least this share of its sketch (mean less 5.5 standard deviations).
SKETCH_FLOOR = 0.6
VERIFY_SETS, VERIFY_TOKENS = 512, 4_000_000


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met in a leaf of the given depth with the given probability."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def chosen_paths(tokens: np.ndarray, runs: int, threshold: float = THRESHOLD) -> list[list[np.ndarray]]:
    """Per level a pair (parents, children) of path ids; the parents of the first level are the runs."""
    out, n = [], len(tokens)
    limit = np.uint64(min(2**64 - 1, int(2**64 / (threshold * n)))) if n else np.uint64(0)
    nodes = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for _ in range(DEPTH):
        parents, children = [], []
        step = max(1, 2_000_000 // max(1, n))  # nodes at a time, which bounds memory for very long texts
        for a in range(0, len(nodes), step):
            some = nodes[a : a + step]
            drawn = mix(tokens[None, :] ^ some[:, None])
            row, col = np.nonzero(drawn <= limit)
            parents.append(some[row])
            children.append(mix(drawn[row, col] + some[row]))
        nodes = np.concatenate(children) if children else np.zeros(0, np.uint64)
        out.append([np.concatenate(parents) if parents else nodes, nodes])
    return out


def document_sets(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n, sketch, up1.. at1..): the set of every document with its paths as arrays of ids."""
    small_batches(docs.sparkSession)
    names = [f"{x}{k}" for k in range(1, DEPTH + 1) for x in ("up", "at")]

    def make(batches):
        for p in batches:
            rows = []
            for i, t in zip(p["doc_id"], p["text"], strict=True):
                tokens = shingle_set(t)
                levels = chosen_paths(tokens, runs)
                rows.append((i, set_key(tokens), len(tokens), sketch(tokens), *[x.view(np.int64) for pair in levels for x in pair]))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "n", "sketch", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, key string, n long, sketch binary, " + ", ".join(f"{x} array<long>" for x in names)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(make, schema)


def leaf_members(sets: DataFrame) -> DataFrame:
    """(leaf, part, side, key): the buckets to search.  A leaf of more than BLOCK sets below the last level becomes pairs of blocks."""
    leaves, big = [], None
    for level in range(1, DEPTH + 1):
        rows = sets.select("key", F.explode_outer(F.arrays_zip(F.col(f"up{level}").alias("up"), F.col(f"at{level}").alias("at"))).alias("p")).select("key", F.col("p.up").alias("up"), F.col("p.at").alias("leaf")).filter("leaf is not null")
        if big is not None:
            rows = rows.join(big.select(F.col("leaf").alias("up")), "up", "left_semi")
        rows = materialize(rows.select("key", "leaf").distinct(), f"level{level}")
        sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("sets")).filter("sets >= 2")
        big = materialize(sizes.filter(F.col("sets") > LEAF), "big")
        leaves.append(rows.join(sizes.filter(F.col("sets") <= LEAF), "leaf").select("leaf", F.lit("0").alias("part"), "key"))
        last = rows
    wide = last.join(big, "leaf").withColumn("blocks", F.ceil(F.col("sets") / BLOCK).cast("int"))
    wide = wide.withColumn("own", F.pmod(F.hash("key"), F.col("blocks")))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws("-", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    leaves.append(wide.select("leaf", part.alias("part"), "key"))
    out = leaves[0]
    for x in leaves[1:]:
        out = out.union(x)
    return out


def sketch_links(sketches: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Roots of the graph of pairs whose sketches and sizes allow the threshold; members that are joined already are skipped."""
    m = len(sketches)
    label = np.arange(m)
    filled = sketches > 0
    for i in range(m - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(rest) == 0:
            continue
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[low >= (THRESHOLD - 1e-9) * high]
        if len(rest) == 0:
            continue
        agree = ((sketches[rest] == sketches[i]) & filled[i]).sum(1)
        either = (filled[rest] | filled[i]).sum(1)
        for j in np.unique(label[rest[agree >= SKETCH_FLOOR * either]]):
            label[label == max(label[i], j)] = min(label[i], j)
    return label


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(key, group) for the sets that some leaf's sketches link to another set."""
    members = leaf_members(sets).join(sets.select("key", "n", "sketch"), "key")
    spread = members.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "key")

    def search(batches):
        for g in stream_groups(batches, ["leaf", "part"]):
            if len(g) < 2:
                continue
            keys = g["key"].to_numpy()
            found = sketch_links(np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, SKETCH), g["n"].to_numpy())
            own = np.flatnonzero(found != np.arange(len(found)))
            if len(own):
                yield pd.DataFrame({"a": keys[own], "b": keys[found[own]]})

    edges = materialize(spread.mapInPandas(search, "a string, b string").distinct(), "sketch-edges")
    return connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("group"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections."""
    m = len(sets)
    both = np.zeros((m, m), np.float64)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return both
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # a token of one set alone is in no intersection
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    step = 8192
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        lo, hi = np.searchsorted(code, [a, a + step])
        table = np.zeros((m, step), np.float32)
        table[owner[lo:hi], code[lo:hi] - a] = 1
        both += table @ table.T
    np.fill_diagonal(both, 0)
    return both


def verify_groups(members: DataFrame) -> DataFrame:
    """(key, links, root) partial results from (group, part, block, key, copies, tokens) rows.

    links: copies of other sets that are similar enough; root: least key that this task joins the set to.  Parts "i-j" of
    different blocks compare across the blocks only, so that a pair counts once.
    """
    spread = members.repartition("group", "part").sortWithinPartitions("group", "part", "key")

    def check(batches):
        for g in stream_groups(batches, ["group", "part"]):
            if len(g) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in g["tokens"]]
            size = np.array([len(s) for s in sets])
            both = intersections(sets)
            similar = both >= THRESHOLD * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(similar, False)
            block, part = g["block"].to_numpy(), g["part"].iloc[0]
            counted = similar if part.split("-")[0] == part.split("-")[1] else similar & (block[:, None] != block[None, :])
            links = counted @ g["copies"].to_numpy()
            forest = Forest(len(g))
            for i, j in zip(*np.nonzero(np.triu(counted)), strict=True):
                forest.join(int(i), int(j))
            own = np.flatnonzero(links > 0)
            keys = g["key"].to_numpy()
            if len(own):
                yield pd.DataFrame({"key": keys[own], "links": links[own].astype(np.int64), "root": keys[forest.roots()[own]]})

    return spread.mapInPandas(check, "key string, links long, root string")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies and key.

    class_id: least id of the documents joined to it by links (Jaccard similarity of shingle sets of 0.8 or more, chained);
    n_links: number of other documents that it is linked to, copies (n_copies - 1 of them) included.  Texts under five words are
    one shingle.  Null, empty and blank texts have no shingles: each is a class of its own without links.  Rows that repeat an id
    stay rows of their own; ids may be null.  An empty table gives no rows.
    """
    with scratch() as keep:
        found = materialize(document_sets(docs, runs_for(recall), id_col, text_col), "sets")
        names = [c for c in found.columns if c[:2] in ("up", "at")]
        rows = materialize(found.select("doc_id", "key", "n"), "rows")
        copies = rows.filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
        copies = materialize(copies, "copies")
        sets = materialize(found.filter("n > 0").select("key", "n", "sketch", *names).dropDuplicates(["key"]), "distinct-sets")
        release(found)
        groups = materialize(candidate_groups(sets), "groups")
        release(sets)
        mass = groups.join(copies, "key").groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
        mass = mass.withColumn("blocks", F.greatest(F.ceil(F.col("sets") / VERIFY_SETS), F.ceil(F.col("tokens") / VERIFY_TOKENS)).cast("int"))
        wanted = groups.join(copies, "key").join(mass.select("group", "blocks"), "group").withColumn("block", F.pmod(F.hash("key"), F.col("blocks")))
        wanted = materialize(wanted.select("key", "group", "block", "blocks", "copies", "first_id"), "wanted")
        return keep(materialize(_finish(rows, copies, _tokens(docs, wanted, id_col, text_col)), "classes-of-documents"))


def _tokens(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted with the shingle set of each key, computed again from the text of its first document."""
    maybe = maybe_among(docs.sparkSession, wanted, "first_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter(maybe(F.col("_id")))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("first_id"))).select("text", "key", "group", "block", "blocks", "copies")

    def make(batches):
        for p in batches:
            sets = [shingle_set(t) for t in p["text"]]
            own = [set_key(s) == k for s, k in zip(sets, p["key"], strict=True)]  # an id may have other texts too
            out = p.drop(columns="text").assign(tokens=[s.tobytes() for s in sets])
            yield out[np.array(own, bool)]

    schema = "key string, group string, block int, blocks int, copies long, tokens binary"
    made = found.mapInPandas(make, schema).dropDuplicates(["group", "key"])
    made = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws("-", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    return made.withColumn("part", part).drop("other", "blocks")


def _finish(rows: DataFrame, copies: DataFrame, members: DataFrame) -> DataFrame:
    partial = materialize(verify_groups(members), "partial")
    joined = connected_components(partial.select(F.col("key").alias("a"), F.col("root").alias("b")).distinct())
    links = partial.groupBy("key").agg(F.sum("links").alias("links"))
    per_key = copies.join(links, "key", "left").join(joined.withColumnRenamed("node", "key"), "key", "left")
    per_key = per_key.withColumn("component", F.coalesce("component", "key"))
    least = per_key.groupBy("component").agg(F.min("first_id").alias("class_id"))
    per_key = materialize(per_key.join(least, "component").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id"), "classes")
    out = rows.join(per_key, "key", "left")
    return out.select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), "key",
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with one document (the least id) of each class; the columns stay as they are, whatever their names.

    Documents without words all stay.  Among rows that repeat the least id one stays.  Tables may be empty, ids null.
    """
    with scratch() as keep:
        found = near_duplicates(docs, id_col, text_col, **kw)
        own = F.col("doc_id").eqNullSafe(F.col("class_id"))
        unique = found.select("doc_id").distinct().count() == found.count()
        decided = keep(materialize(found.filter(~own).select("doc_id") if unique else found.filter(own).select("doc_id", F.col("key").alias("own_key")).distinct(), "decided"))
    if unique:
        return without_rows(docs, decided, id_col, "doc_id")

    @F.pandas_udf("string")
    def key(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(shingle_set(t)) for t in texts], dtype="object")

    d = packed(docs, id=F.col(id_col), row_key=key(F.col(text_col).cast("string")))
    kept = d.join(decided, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("own_key")), "left_semi")
    some = kept.filter(F.col("row_key") != "").dropDuplicates(["id", "row_key"])
    return unpacked(some.unionByName(kept.filter(F.col("row_key") == "")), docs.columns)


def op4_chosen_path_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("key")

"""Operator 12: near-duplicate embeddings by int8 quantised tile products.

Equal vectors of a label become one.  The distinct unit vectors of a label are sliced along fixed directions into tiles of about
TILE vectors; a tile holds its vectors as int8 with one scale and one residual norm each.  Tiles whose slices lie too far apart to
hold a pair at the threshold never meet.  The others meet as blocks of tiles: an integer product gives every cosine up to an error
that the residual norms bound rigorously.  Pairs certainly below the threshold end there; tile pairs with any other pair meet once
more with their full vectors, and only the pairs that the bounds leave open are computed in double precision.

A task tells numbers of links and a spanning forest of the links it found, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, load, materialize, packed, scratch, unpacked

THRESHOLD = 0.98
#: Distinct vectors of a tile (fewer where they have over 256 components), and tiles on either side of a block: a task holds two
#: blocks, of int8 rows or of full vectors.
TILE, BLOCK, TILE_NUMBERS = 1024, 8, 1 << 18
#: Directions along which tiles are sliced (two) and bounded (all).
DIRECTIONS = 8
#: What double precision may lose in a cosine, generously.
SLACK = 1e-9
#: Elements of a product computed at once; integer sums of so many int8 products stay exact in single precision.
EXACT = 1024


def is_vector(v: Column) -> Column:
    """Whether a vector can link: not null, not empty, not zero, and all components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that tiny or huge components neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, residual norm): unit = scale * row + residual."""
    scale = np.abs(unit).max(axis=1) / 127
    rows = np.rint(unit / scale[:, None]).astype(np.int8)
    return rows, scale, np.linalg.norm(unit - scale[:, None] * rows, axis=1) + 1e-12


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of int8 rows, in parts whose sums single precision holds exactly."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def bounds(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error): the cosine of row i of a and row j of b lies within estimate +- error.

    With u = su*qu + eu and v = sv*qv + ev: u.v - su*sv*qu.qv = (u - eu).ev + eu.v, at most (1 + |eu|)*|ev| + |eu|.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    return int8_product(qa, qb) * sa[:, None] * sb[None, :], (1 + ea[:, None]) * eb[None, :] + ea[:, None] + SLACK


def _directions(size: int) -> np.ndarray:
    """Orthonormal directions, alike in every task."""
    q, _ = np.linalg.qr(np.random.default_rng(12).standard_normal((size, min(size, DIRECTIONS))))
    return q.T


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(node, group, size, vector, copies, least, at): one row per distinct vector of a label; at: places along the directions.

    rows: (group, vector, id).  node numbers them; the numbers hold because the table is written once.
    """
    d = rows.groupBy("group", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    d = d.withColumns({"size": F.size("vector"), "node": F.monotonically_increasing_id()})

    def place(batches):
        for b in batches:
            sizes, at = np.asarray(b.column("size")), [None] * b.num_rows
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                found = unit_rows(_matrix(b.column("vector").take(pa.array(own))).astype(np.float64)) @ _directions(int(n)).T
                for i, row in zip(own.tolist(), found.tolist(), strict=True):
                    at[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.list_(pa.float64()))], [*b.schema.names, "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return materialize(d.mapInArrow(place, fields + ", at array<double>"), "vectors")


def _sliced(d: DataFrame, by: list[str], place: Column, parts: str, out: str) -> DataFrame:
    """d with out: which of its group's parts (a column) equal slices along place a row falls into, by approximate quantiles."""
    cuts = d.groupBy(*by).agg(F.percentile_approx(place, F.array(*[F.lit(k / 64) for k in range(1, 64)]), 10_000).alias("cuts"))
    d = d.join(cuts, by)
    rank = F.size(F.filter("cuts", lambda c: c <= place))  # 0..63
    return d.withColumn(out, F.floor(rank * F.col(parts) / 64).cast("int")).drop("cuts")


def tiled(vectors: DataFrame, tile: int) -> DataFrame:
    """vectors with tile, a number per (group, size) that holds about so many of them.

    A group is cut into slices along one direction and these along a second one; a slice that still holds more is dealt out by
    node.  All counts are per slice, so no task sees a whole label.
    """
    by = ["group", "size"]
    tile = F.least(F.lit(tile), F.ceil(F.lit(TILE_NUMBERS) / F.col("size")))
    n = vectors.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.least(F.lit(64), F.ceil(F.sqrt(F.col("n") / tile))).cast("int")).drop("n")
    d = _sliced(vectors.join(n, by), by, F.get("at", F.lit(0)), "parts", "s1")
    d = _sliced(d, [*by, "s1"], F.coalesce(F.get("at", F.lit(1)), F.lit(0.0)), "parts", "s2")
    shares = d.groupBy(*by, "s1", "s2").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("shares"))
    order = Window.partitionBy(*by).orderBy("s1", "s2")  # at most 64 x 64 slices
    shares = shares.withColumn("base", F.coalesce(F.sum("shares").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(shares, [*by, "s1", "s2"])
    return d.withColumn("tile", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("shares"))).cast("int")).drop("parts", "s1", "s2", "shares", "base")


def pack_tiles(d: DataFrame) -> DataFrame:
    """One row per tile: nodes, copies, int8 rows, scales, residual norms and full vectors as bytes; low and high of its places."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = _matrix(table.column("vector"))
        q, scale, error = quantised(unit_rows(x.astype(np.float64)))
        at = _matrix(table.column("at"))
        one = lambda name: table.column(name).combine_chunks()[:1]
        data = [np.asarray(table.column(c)).astype(np.int64).tobytes() for c in ("node", "copies")] + [v.tobytes() for v in (q, scale, error, x)]
        names = ["group", "size", "tile", "nodes", "copies", "q", "scale", "error", "full", "low", "high"]
        columns = [one("group"), one("size"), one("tile"), *[pa.array([v], pa.binary()) for v in data], *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (at.min(axis=0), at.max(axis=0))]]
        return pa.table(columns, names=names)

    kind = d.schema["group"].dataType.simpleString()
    schema = f"`group` {kind}, size int, tile int, nodes binary, copies binary, q binary, scale binary, error binary, full binary, low array<double>, high array<double>"
    return materialize(d.select("group", "size", "tile", "node", "copies", "vector", "at").groupBy("group", "size", "tile").applyInArrow(pack, schema), "tiles")


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(group, size, a, b) with a <= b: tiles of a label whose boxes are near enough to hold a pair at the threshold.

    Unit vectors at cosine c are sqrt(2 - 2c) apart, and so their places along orthonormal directions are at most.
    """
    by = ["group", "size"]
    slim = tiles.select(*by, "tile", "low", "high")
    last = slim.groupBy(*by).agg(F.max("tile").alias("last"))
    pairs = slim.join(last, by).select(*by, F.col("tile").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.explode(F.sequence("tile", "last")).alias("b"))
    pairs = pairs.join(slim.select(*by, F.col("tile").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb")), [*by, "b"])
    ahead = lambda high, low: F.zip_with(high, low, lambda h, x: F.greatest(F.lit(0.0), x - h))
    gap = F.zip_with(ahead("ha", "lb"), ahead("hb", "la"), lambda x, y: F.greatest(x, y))
    far = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return pairs.filter(far <= 2 - 2 * threshold + 1e-6).select(*by, "a", "b")


def _in_blocks(pairs: DataFrame, tiles: DataFrame, columns: list[str], block: int) -> DataFrame:
    """The tiles of every pair of blocks, each once, with the pairs they are in: rows to group by (group, size, ba, bb)."""
    by = ["group", "size"]
    p = pairs.withColumns({"ba": F.floor(F.col("a") / block), "bb": F.floor(F.col("b") / block)})
    ends = p.withColumn("tile", F.explode(F.array_distinct(F.array("a", "b")))).withColumn("with", F.when(F.col("tile") == F.col("a"), F.col("b")))
    needed = ends.groupBy(*by, "ba", "bb", "tile").agg(F.collect_list("with").alias("partners"))  # at most block of them
    return needed.join(tiles.select(*by, "tile", *columns), [*by, "tile"])


def _read(table: pa.Table, columns: list[str]) -> dict[int, dict]:
    kinds = {"nodes": np.int64, "copies": np.int64, "q": np.int8, "scale": np.float64, "error": np.float64, "full": np.float64}
    out = {}
    for row in table.select(["tile", "size", "partners", *columns]).to_pylist():
        if "full" in columns:  # as wide as the input
            kinds["full"] = np.dtype(f"f{8 * len(row['full']) // (row['size'] * len(row['nodes']))}")
        held = {c: np.frombuffer(row[c], kinds[c]) for c in columns}
        for c in ("q", "full"):
            if c in held:
                held[c] = held[c].reshape(-1, row["size"])
        out[row["tile"]] = held | {"partners": sorted(row["partners"])}
    return out


def open_pairs(tiles: DataFrame, pairs: DataFrame, threshold: float, block: int) -> DataFrame:
    """The pairs of tiles of which the int8 products leave some pair of vectors possibly at the threshold."""
    columns = ["q", "scale", "error"]

    def test(table: pa.Table) -> pa.Table:
        held, out = _read(table, columns), []
        for a, x in held.items():
            for b in x["partners"]:
                near, error = bounds(*[tuple(held[t][c] for c in columns) for t in (a, b)])
                hit = near + error >= threshold
                if a == b:
                    hit = np.triu(hit, 1)
                if hit.any():
                    out.append((a, b))
        n = len(out)
        first = lambda c: pa.chunked_array([table.column(c).combine_chunks().take(pa.array([0] * n, pa.int64()))])
        return pa.table([first("group"), first("size"), pa.array([a for a, _ in out], pa.int32()), pa.array([b for _, b in out], pa.int32())], names=["group", "size", "a", "b"])

    kind = tiles.schema["group"].dataType.simpleString()
    met = _in_blocks(pairs, tiles, columns, block).groupBy("group", "size", "ba", "bb")
    return materialize(met.applyInArrow(test, f"`group` {kind}, size int, a int, b int"), "open-pairs")


def linked(a: dict, b: dict, same: bool, threshold: float, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): rows of two tiles, each pair once, whose cosine is at the threshold; only open pairs are computed in full."""
    near, error = bounds(*[(t["q"], t["scale"], t["error"]) for t in (a, b)])
    maybe = near + error >= threshold
    if same:
        maybe = np.triu(maybe, 1)
    sure = maybe & (near - error >= threshold)
    i, j = np.nonzero(maybe & ~sure)
    kept = np.zeros(len(i), bool)
    for k in range(0, len(i), step):
        x, y = a["full"][i[k : k + step]].astype(np.float64), b["full"][j[k : k + step]].astype(np.float64)
        kept[k : k + step] = cosines(x, y) >= threshold
    si, sj = np.nonzero(sure)
    return np.concatenate([si, i[kept]]), np.concatenate([sj, j[kept]])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    dot = lambda p, q: np.einsum("ij,ij->i", p, q)
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number connected with each of 0..n-1 by the edges (u, v)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def found_links(tiles: DataFrame, pairs: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links, root): links to other distinct vectors, counted with their copies, and the least node of the part of the
    block's graph that the node is in."""
    columns = ["nodes", "copies", "q", "scale", "error", "full"]

    def count(table: pa.Table) -> pa.Table:
        held = _read(table, columns)
        start = dict(zip(held, np.cumsum([0, *[len(t["nodes"]) for t in held.values()]]).tolist(), strict=False))
        nodes = np.concatenate([t["nodes"] for t in held.values()])
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        for a, x in held.items():
            for b in x["partners"]:
                y = held[b]
                i, j = linked(x, y, a == b, threshold)
                np.add.at(links, start[a] + i, y["copies"][j])
                np.add.at(links, start[b] + j, x["copies"][i])
                u, v = np.divmod(np.unique(root[start[a] + i] * len(nodes) + root[start[b] + j]), len(nodes))
                root = forest(u, v, len(nodes))[root]
        some = np.flatnonzero(links)
        return pa.table([nodes[some], links[some], nodes[root[some]]], names=["node", "links", "root"])

    met = _in_blocks(pairs, tiles, columns, block).groupBy("group", "size", "ba", "bb")
    return materialize(met.applyInArrow(count, "node long, links long, root long"), "vector-links")


def near_duplicates(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = THRESHOLD, tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """embeddings plus n_links, component_id and kept, one row for each of its rows; the new columns replace columns of these names.

    Rows link when their labels are equal and not null, their vectors have the same number of components and a cosine of threshold
    (above 0) or more.  n_links counts the other rows linked directly; component_id is the least id that links reach; kept marks
    rows whose id it is.  Rows whose vector is null, empty, zero or holds null or non-finite components link with nothing and stay.
    Every row is a vector of its own: rows that share an id are linked by their vectors only.  Ids may be null: a component without
    any id has none.  label_col None compares all rows.  The table may be empty.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    rows = packed(embeddings, id=F.col(id_col), group=label, vector=F.col(vector_col))
    rows = rows.withColumn("usable", is_vector(F.col("vector")) & F.col("group").isNotNull())
    with scratch() as keep:
        vectors = distinct_vectors(rows.filter("usable").select("group", "vector", "id"))
        tiles = pack_tiles(tiled(vectors, tile))
        pairs = materialize(tile_pairs(tiles, threshold), "tile-pairs")
        found = found_links(tiles, open_pairs(tiles, pairs, threshold, block), threshold, block)
        component = connected_components(found.filter("node <> root").select("node", "root"), "node", "root")
        low = vectors.select("node", "least").join(component, "node").groupBy("component").agg(F.min("least").alias("low"))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        known = vectors.join(links, "node", "left").join(component, "node", "left").join(low, "component", "left").select(
            F.col("group").alias("g"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("low", "least").alias("c"))
        known = keep(materialize(known, "vector-classes"))
    d = rows.join(known, F.col("usable") & (F.col("group") == F.col("g")) & (F.col("vector") == F.col("v")), "left")
    c = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("c"))
    return unpacked(d, embeddings.columns, n_links=F.coalesce("n", F.lit(0)).cast("long"), component_id=c, kept=c.eqNullSafe(F.col("id")))


def keep_one_vector(embeddings: DataFrame, **kw) -> DataFrame:
    """embeddings without the rows that a row of lower id makes redundant; of a component the rows of its least id stay."""
    return near_duplicates(embeddings, **kw).filter("kept").select(*[f"`{c}`" for c in embeddings.columns])


def op12_int8_tiles(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


#: The same links by comparing all vectors of a label, and what they reach.
OP12_SQL = """
with v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), r as (
  with recursive reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a) select a, min(b) as low from reach group by a
), n as (
  select a, count(*) as n from l group by a
)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) as component_id,
  e.vec_id <= coalesce(r.low, e.vec_id) as kept
from embeddings e left join n on e.vec_id = n.a left join r on e.vec_id = r.a
"""

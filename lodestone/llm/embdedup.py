"""Operator 1: near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so the leading coordinates hold most of every product.
They are cut into tiles by the two leading coordinates; pairs of tiles whose boxes lie too far apart are
never compared. In a pair of tiles, products accumulate over blocks of coordinates; what the rest can
still add is bounded by the product of the suffix norms, and a pair stops when its bound is below the
threshold. What survives is verified on the original vectors in double precision. Nothing is approximate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, label
from .session import read, unused, written

THRESHOLD = 0.95
TILE_ROWS = 2048
#: Coordinates in each tile's box.
BOX = 8
STEPS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
SLACK = 1e-5


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def axes(vectors: DataFrame, d: int) -> np.ndarray:
    """The d x d rotation to principal axes, largest first; only d x d sums reach the driver."""

    def moment(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0), d).astype(float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = vectors.select("vector").mapInArrow(moment, "i long, row array<double>").groupBy("i").agg(*(F.sum(F.col("row")[k]).alias(str(k)) for k in range(d))).orderBy("i").collect()
    m = np.array([r[1:] for r in rows], float) if rows else np.eye(d)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def alike(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of rotated unit rows whose cosine can reach the threshold (i < j if a is b)."""
    d = a.shape[1]
    steps = [s for s in STEPS if s < d] + [d]
    limit = threshold - SLACK

    def rest(x, k):
        return np.sqrt(np.maximum((x[:, k:].astype(float) ** 2).sum(1), 0)).astype(np.float32)

    k = steps[0]
    dot = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(dot + rest(a, k)[:, None] * rest(b, k) >= limit)
    if same:
        i, j = i[i < j], j[i < j]
    total = dot[i, j]
    dense = len(i) > 0.05 * dot.size
    for k, end in zip(steps, steps[1:]):
        if not len(i):
            break
        if dense:  # most pairs are still open: one matrix product is cheaper than pair by pair
            dot += a[:, k:end] @ b[:, k:end].T
            total = dot[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a[i, k:end], b[j, k:end])
        ra, rb = rest(a, end), rest(b, end)
        keep = total + ra[i] * rb[j] >= limit
        i, j, total = i[keep], j[keep], total[keep]
        dense = dense and len(i) > 0.05 * dot.size
    return i, j


def near_edges(df: DataFrame, d: int, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b) edges that join what cosine >= threshold joins. df has id long and vector array<float> of d finite numbers, not all 0."""
    spark = df.sparkSession
    turn = axes(df, d).astype(np.float32)
    box = min(BOX, d)

    def rotated(x, columns=None):
        """Unit rows on the principal axes, which is cheaper to do again than to send."""
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        return ((x / norm[:, None]).astype(np.float32) @ turn[:, :columns]).astype(np.float32)

    def lead(batches):
        for batch in batches:
            y = rotated(_matrix(batch.column(1), d), min(2, d))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y[:, 0]), pa.array(y[:, -1])], ["id", "vector", "x", "y"])

    turned = written(df.select("id", "vector").mapInArrow(lead, "id long, vector array<float>, x float, y float"), "turned")
    n = turned.count()
    strips = max(1, math.isqrt(math.ceil(n / tile_rows)))
    cells = max(1, math.ceil(n / tile_rows / strips))

    def cut(parts):
        return [k / parts for k in range(1, parts)] or [0.5]

    def place(column, at):
        return F.size(F.filter(at, lambda q: q < column))

    first = turned.agg(F.percentile_approx("x", cut(strips)).alias("at")).first()["at"] or []
    first = [float(q) for q in first] if strips > 1 else []
    strip = place(F.col("x"), F.array(*map(F.lit, first))) if first else F.lit(0)
    placed = turned.withColumn("strip", strip)
    second = placed.groupBy("strip").agg(F.percentile_approx("y", cut(cells)).alias("at"))
    placed = placed.join(F.broadcast(second), "strip")  # a row a strip; strips grow with the root of the tiles
    placed = placed.withColumn("tile", F.col("strip") * cells + (place(F.col("y"), F.col("at")) if cells > 1 else F.lit(0)))

    def blob(key, table):
        table = table.combine_chunks().sort_by("id")
        v = _matrix(table.column("vector").combine_chunks(), d).astype(np.float32)
        t = rotated(v, box)
        out = {"tile": [key[0].as_py()], "ids": [table.column("id").to_numpy().astype(np.int64).tobytes()], "vectors": [v.tobytes()], "low": [t.min(0).astype(float).tolist()], "high": [t.max(0).astype(float).tolist()]}
        return pa.table(out, schema=pa.schema([("tile", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    tiles = written(placed.select(F.col("tile").cast("long").alias("tile"), "id", "vector").groupBy("tile").applyInArrow(blob, "tile long, ids binary, vectors binary, low array<double>, high array<double>"), "tiles")
    box_a, box_b = (tiles.select(F.col("tile").alias(c), F.col("low").alias(f"low_{c}"), F.col("high").alias(f"high_{c}")) for c in "ab")
    far = F.expr("aggregate(zip_with(zip_with(low_a, high_b, (l, h) -> greatest(l - h, 0D)), zip_with(low_b, high_a, (l, h) -> greatest(l - h, 0D)), (p, q) -> greatest(p, q)), 0D, (t, g) -> t + g * g)")
    pairs = box_a.join(box_b, F.col("a") <= F.col("b")).filter(far <= 2 - 2 * threshold + SLACK).select("a", "b")
    side_a, side_b = (tiles.select(F.col("tile").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("ids", "vectors"))) for c in "ab")
    work = pairs.join(side_b, "b").repartition(max(8, spark.sparkContext.defaultParallelism * 2), "a", "b").join(side_a, "a")

    def compare(batches):
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for r in range(batch.num_rows):
                m = {c: np.frombuffer(col[c][r].as_buffer(), np.int64 if c.startswith("ids") else np.float32) for c in col if c not in "ab"}
                ids_a, ids_b = m["ids_a"], m["ids_b"]
                va, vb = m["vectors_a"].reshape(-1, d), m["vectors_b"].reshape(-1, d)
                i, j = alike(rotated(va), rotated(vb), threshold, col["a"][r].as_py() == col["b"][r].as_py())
                for at in range(0, len(i), 200_000):
                    p, q = va[i[at : at + 200_000]].astype(float), vb[j[at : at + 200_000]].astype(float)
                    cos = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
                    ok = np.flatnonzero(cos >= threshold) + at
                    node, comp = label(ids_a[i[ok]], ids_b[j[ok]])  # a spanning star of each group, not all of its pairs
                    apart = node != comp
                    yield pa.RecordBatch.from_arrays([pa.array(comp[apart]), pa.array(node[apart])], ["a", "b"])

    return work.mapInArrow(compare, "a long, b long").distinct()


def near_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """df without its vectors, with group_id (the smallest id of the connected group) and is_kept (id = group_id).

    Equal vectors are first made one. Vectors are compared with those of their own length, of which there may
    be any number. A vector that is null, empty, all zeros, or holds a null or a number that isn't finite is alone. A row with a null id has a null group and is
    kept. Rows that share an id are one item, which all their vectors link. Other columns pass untouched,
    but those named group_id or is_kept are replaced.
    """
    kept = [c for c in df.columns if c not in (vector_col, "group_id", "is_kept")]
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)) & F.exists(v, lambda x: F.abs(x) > 1e-15)
    rows = df.filter(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    same = rows.groupBy("vector").agg(F.min("id").alias("id"))
    lead = same.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))
    copies = rows.select("id", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")).join(lead.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).filter("id <> b").select(F.col("id").alias("a"), "b")
    sizes = [r["d"] for r in rows.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()]  # one row a kind of vector
    edges = copies
    for d in sizes:
        edges = edges.union(near_edges(same.filter(F.size("vector") == d).select("id", "vector"), d, threshold, tile_rows))
    node, comp = unused(df, "node"), unused(df, "comp")
    groups = components(written(edges, "edges")).select(F.col("node").alias(node), F.col("comp").alias(comp))
    out = df.select(*kept).join(groups, F.col(id_col).cast("long") == F.col(node), "left")
    return out.select(*kept, F.coalesce(comp, F.col(id_col).cast("long")).alias("group_id"), F.coalesce(F.col(id_col).cast("long") == F.col(comp), F.lit(True)).alias("is_kept"))


def embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Every embedding's near-duplicate group."""
    return near_dedup(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


EMBEDDING_SQL = f"""
WITH RECURSIVE edges AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD}),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT x AS vec_id, min(y) AS group_id, x = min(y) AS is_kept FROM reach GROUP BY x
"""

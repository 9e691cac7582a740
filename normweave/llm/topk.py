"""Exact top-k by inner product: columnar branch-and-bound.

Vectors of a block are laid out dimension by dimension, those of most energy first. Scores of a query
against the block are accumulated one block of dimensions at a time; what the remaining dimensions can
still add is at most the product of the remaining norms. A candidate whose best case is below the bar, a
score that k rows are known to reach, is compacted away. Each query brings a bar from the rows of the
greatest norms, so that low norms go before their first dimension; the block's own rows raise it.

The stated queries meet all rows in cells of one query block and one vector block, both of bounded size,
and each cell gives at most k rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, table

#: Vectors and queries of a cell; rows of the greatest norms that give bars; dimensions added at a time.
BLOCK, QUERY_BLOCK, SEEDS, DIMENSIONS = 4096, 1024, 512, 8
_NULL = np.iinfo(np.int64).max  # a null id, last among ties


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers: as floats below 2**53, else as Python's integers; beyond 64 bits an OverflowError."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    if top < 2**53:
        return queries @ vectors.T
    if not np.isfinite(queries).all() or not np.isfinite(vectors).all():
        raise OverflowError("a scaled component is beyond the range of doubles")
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    scores = whole(queries) @ whole(vectors).T if queries.size and vectors.size else np.zeros((len(queries), len(vectors)), object)
    if any(not -(2**63) <= int(s) < 2**63 for s in scores.ravel()):
        raise OverflowError("a score is beyond 64 bits")
    return scores


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = sorted(range(len(score)), key=lambda j: (-int(score[j]), int(ids[j]))) if score.dtype == object else np.lexsort((ids, -score))
    return [(int(score[j]), int(ids[j])) for j in order[:k]]


def best(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, bars: np.ndarray | None = None, seen: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """Of each query the k highest (score, id) that reach its bar, ties to the smaller id.

    own[i]: the query's own row among the vectors, or -1. queries and vectors hold whole numbers. Scores are
    exact: see `_exact`. seen: gets the number of candidates that each query read each block of dimensions for.
    """
    bars = np.full(len(queries), -np.inf) if bars is None else bars
    dims = vectors.shape[1]
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, dims)
    if not top < 2**53 or len(vectors) <= 4 * k or not dims:
        out = []
        for i in range(len(queries)):
            who = np.flatnonzero(np.arange(len(vectors)) != own[i])
            s = _exact(queries[i : i + 1], vectors[who])[0]
            near = np.array([x >= bars[i] for x in s], bool)
            out.append(_top(s[near], ids[who][near], k))
        return out
    order = np.argsort(-np.square(vectors).sum(axis=0) * np.square(queries).sum(axis=0), kind="stable")
    vectors, queries = vectors[:, order], queries[:, order]
    edges = [*range(0, dims, DIMENSIONS), dims]
    left = lambda m: [np.sqrt(np.square(m[:, e:]).sum(axis=1)) * (1 + 1e-9) for e in edges]
    rest_q, rest_v = left(queries), left(vectors)
    high = np.argsort(-rest_v[0], kind="stable")
    columns, place = np.ascontiguousarray(vectors[high].T), np.argsort(high)
    rest_v, ids = [r[high] for r in rest_v], ids[high]
    own = np.where(own >= 0, place[np.maximum(own, 0)], -1)
    first = queries @ columns[:, : min(len(high), max(4 * k, 128))]  # whole scores of the greatest norms
    out = []
    for i in range(len(queries)):
        mine = first[i]
        mine = np.delete(mine, own[i]) if 0 <= own[i] < len(mine) else mine
        bar = max(bars[i], -np.partition(-mine, k - 1)[k - 1]) if len(mine) >= k else bars[i]
        alive, score = np.flatnonzero(np.arange(len(high)) != own[i]), None
        for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
            rest = rest_q[b][i] * rest_v[b][alive]
            stay = (rest if score is None else score + rest) + 1e-6 >= bar
            if not stay.all():
                alive = alive[stay]
                score = None if score is None else score[stay]
            if seen is not None:
                seen.append(len(alive))
            part = queries[i, lo:hi] @ (columns[lo:hi] if len(alive) == len(high) else columns[lo:hi, alive])
            score = part if score is None else score + part
        stay = score >= bar
        out.append(_top(score[stay], ids[alive[stay]], k))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int, scale: int) -> np.ndarray:
    """Whole numbers floor(scale * x), as floats; zero beyond a vector's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
    return out


def _dims(*columns: pa.Array | pa.ChunkedArray) -> int:
    each = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return max(int(np.diff(c.offsets.to_numpy()).max(initial=0)) for c in each)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(_NULL).to_numpy(zero_copy_only=False)


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products with every row but the query's own.

    Components become floor(scale * x). Null vectors and vectors with a null or non-finite component
    take no part; an empty or shorter vector counts as zero beyond its end. Ties go to the smaller
    vec_id; rows with the same vec_id are rows of their own; a null vec_id comes last among ties. Components
    of any finite size count; a score beyond 64 bits raises an OverflowError. An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "asks", "v"))
    n, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    seeds = rows.sparkSession.sparkContext.broadcast(rows.orderBy(F.desc(norm), "row").limit(SEEDS).select("row", "v").toArrow())

    def barred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = seeds.value
        for batch in batches:
            v = batch.column(2)
            bars = np.full(batch.num_rows, -np.inf)
            if batch.num_rows and seed.num_rows > k:
                dims = _dims(v, seed["v"])
                q, s = _matrix(v, dims, scale), _matrix(seed["v"], dims, scale)
                same = seed["row"].to_numpy()[None, :] == batch.column(0).to_numpy()[:, None]
                if float(np.abs(q).max(initial=0)) * float(np.abs(s).max(initial=0)) * max(1, dims) < 2**53:
                    bars = -np.partition(np.where(same, np.inf, -(q @ s.T)), k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bars)], names=["row", "vec_id", "v", "bar"])

    queries = rows.where("asks").select("row", "vec_id", "v").mapInArrow(barred, "row bigint, vec_id bigint, v array<double>, bar double")
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-asking // QUERY_BLOCK))
    cells = ["block", "query_block"]
    held = rows.select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = queries.select("row", "vec_id", "v", "bar", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"))

    def cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        lists: list[list[tuple[int, int]]] = []
        if held.num_rows and asked.num_rows:
            dims = _dims(held["v"], asked["v"])
            row, mine = held["row"].to_numpy(), asked["row"].to_numpy()
            order = np.argsort(row)
            at = np.minimum(np.searchsorted(row[order], mine), len(row) - 1)
            own = np.where(row[order][at] == mine, order[at], -1)
            lists = best(_matrix(asked["v"], dims, scale), _matrix(held["v"], dims, scale), own, _ids(held["vec_id"]), k, asked["bar"].to_numpy())
        sizes = [len(x) for x in lists]
        pick = np.repeat(np.arange(len(lists)), sizes)
        flat = [y for x in lists for y in x]
        return pa.table(
            {
                "row": asked["row"].take(pa.array(pick, pa.int64())),
                "query_id": asked["vec_id"].take(pa.array(pick, pa.int64())),
                "vec_id": pa.array([None if i == _NULL else i for _, i in flat], pa.int64()),
                "score": pa.array([s for s, _ in flat], pa.int64()),
            }
        )

    found = held.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInArrow(cell, "row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH good AS (
  SELECT vec_id, embedding, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), v AS (
  SELECT rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM good
), s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Exact top-k search by inner product: tiled matrix products and merged lists.

Queries and candidates are packed into tiles (a bounded number of vectors each, as
bytes).  Tiles are dealt out to a grid of cells, as many as the products ask for: a cell
has some tiles of queries and some of candidates, multiplies each with each, selects the
best k of each query from a product and merges them with those so far.  The cells' lists
are merged in two levels, so that no task gets all lists of a query.  A stated query set
meets all rows, in blocks; with n queries and m candidates in g cells about
2 * sqrt(g * n * m) vectors are sent.

Defined cases: a vector that is null or holds a null or non-finite component takes no
part, as query or candidate; vectors are compared only with vectors of their length; a
vector is not its own candidate (rows with its id are left out); ties go to the smaller
id; a repeated row is a candidate as often as it is there, and rows that share a query's id
are one query (the least of its usable vectors); a query with fewer than k candidates gets
all of them; a score beyond 64 bits is the nearest whole number of 64 bits, at which such
scores tie; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a tile; products of tiles in a cell where there are over LEAST times as many, and cells up to which each product is one.
TILE, PRODUCTS, LEAST = 2048, 1024, 64


def _quantised(values: np.ndarray, scale: float) -> np.ndarray:
    """Whole numbers, as doubles; as Python's integers where a scaled component is beyond doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if np.isfinite(scaled).all():
        return scaled
    exact = Fraction(scale)
    return np.array([[math.floor(exact * Fraction(x)) for x in row] for row in values.tolist()], dtype=object)


def _tiles(scale: float, size: int):
    """Packs usable vectors of one length at a time: (dim, ids, data); whole numbers if they all fit into 32 bits, else as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dim: int):
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for a in range(0, len(ids), size):
                part = data[a : a + size]
                narrow = np.abs(part).max() * abs(scale) < 2.0**31 - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()), pa.array([ids[a : a + size].tobytes()], pa.binary()),
                        pa.array([bool(narrow)]), pa.array([(np.floor(scale * part).astype(np.int32) if narrow else part).tobytes()], pa.binary()),
                    ],
                    names=["dim", "ids", "narrow", "data"],
                )

        for batch in batches:
            ids, lists = np.asarray(batch.column(0)), batch.column(1)
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            flat = lists.flatten().cast(pa.float64())
            values = np.asarray(flat.fill_null(np.nan))
            first = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dim)
                vectors = values[first[rows][:, None] + np.arange(dim)]
                good = np.isfinite(vectors).all(axis=1)
                if good.any():
                    held.setdefault(dim, []).append((ids[rows[good]].astype(np.int64), vectors[good]))
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield from packed(dim)
        for dim in list(held):
            yield from packed(dim)

    return run


def _scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these hold every partial sum exactly."""
    huge = queries.dtype == object or shard.dtype == object
    most = math.inf if huge else float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * queries.shape[1]
    if most < 2.0**53:
        return (queries @ shard.T).astype(np.int64)
    if most < 2.0**63:
        return queries.astype(np.int64) @ shard.astype(np.int64).T
    whole = np.array([[int(x) for x in row] for row in queries], dtype=object) @ np.array([[int(x) for x in row] for row in shard], dtype=object).T
    return np.clip(whole, -(2**63) + 2, 2**63 - 1).astype(np.int64)  # beyond 64 bits the score stays at the bound


def _vectors(tile: dict, scale: float) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(tile["data"], np.int32 if tile["narrow"] else np.float64).reshape(-1, tile["dim"])
    return np.frombuffer(tile["ids"], np.int64), data.astype(np.float64) if tile["narrow"] else _quantised(data, scale)


def _selected(k: int, q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate id and score of the best k of each query in one product."""
    scores = _scores(queries, shard)
    own = q_ids[:, None] == c_ids[None, :]
    low = np.iinfo(np.int64).min
    scores[own] = low
    n = min(k, len(c_ids))
    edge = -np.partition(-np.maximum(scores, low + 1), n - 1, axis=1)[:, n - 1]
    row, col = np.nonzero((scores >= edge[:, None]) & ~own)  # ties at the edge stay until they are ranked
    return _cut(k, row, c_ids[col], scores[row, col])


def _cut(k: int, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rank = np.lexsort((ids, -score, row))
    row, ids, score = row[rank], ids[rank], score[rank]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def _cell(k: int, scale: float):
    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        tiles = shards.to_pylist()
        out = []
        for q in queries.to_pylist():
            q_ids, vectors = _vectors(q, scale)
            best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            for tile in tiles:
                found = _selected(k, q_ids, vectors, *_vectors(tile, scale))
                best = _cut(k, *(np.concatenate(x) for x in zip(best, found)))
            out.append((q_ids[best[0]], *best[1:], np.full(len(best[0]), q["part"])))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if tiles and out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(x) for x in columns], names=["query_id", "vec_id", "score", "part"])

    return run


def grid(queries: int, candidates: int, tile: int = TILE) -> tuple[int, int]:
    """Parts of the queries and of the candidates: square cells of a bounded number of products, as far as there are tiles."""
    rows, columns = max(1, math.ceil(queries / tile)), max(1, math.ceil(candidates / tile))
    cells = min(rows * columns, max(LEAST, rows * columns // PRODUCTS))
    parts = min(rows, max(1, round(math.sqrt(cells * rows / columns))))
    return parts, min(columns, math.ceil(cells / parts))


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row of (vec_id, embedding) for which is_query holds."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    pairs = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    asked = pairs.filter("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = pairs.agg(F.count("*").alias("all"), F.count_if("asks").alias("asked")).first()
    q_parts, c_parts = grid(rows["asked"], rows["all"], tile)
    schema = "dim int, ids binary, narrow boolean, data binary"
    shards = pairs.select("vec_id", "embedding").mapInArrow(_tiles(scale, tile), schema).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(c_parts)).cast("int"))
    queries = asked.mapInArrow(_tiles(scale, tile), schema).withColumn("q_part", F.pmod(F.xxhash64("ids"), F.lit(q_parts)).cast("int"))
    # a tile of candidates goes to every part of the queries, and the other way round
    shards = shards.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).groupBy("dim", "part", "q_part")
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1)))).groupBy("dim", "part", "q_part")
    lists = shards.cogroup(queries).applyInArrow(_cell(k, scale), "query_id long, vec_id long, score long, part long")
    order = [F.desc("score"), F.asc("vec_id")]
    group = F.pmod("part", F.lit(math.isqrt(c_parts) or 1))
    some = lists.withColumn("group", group).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "group").orderBy(*order))).filter(F.col("r") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")

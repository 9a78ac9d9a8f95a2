"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block: what one task holds.
CANDIDATES, QUERIES = 8192, 2048
#: Query rows whose dense score arrays are filled together; with CANDIDATES longs each they stay in the cache.
TILE = 16


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = values[offsets[0] : offsets[-1]]
    return out


def _best(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            width = max(int(np.diff(t.column("_terms").combine_chunks().offsets.to_numpy()).max()) for t in (queries, rows))
            asked, ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, terms = ids[order], _matrix(rows.column("_terms"), width)[order].T.copy()
            weights = _matrix(queries.column("_terms"), width)
            largest = [float(np.abs(x.astype(float)).max(initial=0)) for x in (terms, weights)]
            if width * largest[0] * largest[1] >= 2.0**63:
                raise OverflowError("scores of these vectors may not fit in 64 bits")
            postings = [(None if (at := np.flatnonzero(x)).size == x.size else at, x[at]) for x in terms]
            for a in range(0, len(asked), TILE):
                tile = weights[a : a + TILE]
                scores = np.zeros((len(tile), len(ids)), np.int64)
                for term, (at, values) in enumerate(postings):
                    which = np.flatnonzero(tile[:, term])
                    if not which.size or not values.size:
                        continue
                    if at is None:
                        for q in which:
                            scores[q] += tile[q, term] * values
                    else:
                        for q in which:
                            scores[q, at] += tile[q, term] * values
                for q in range(len(tile)):
                    mine = scores[q]
                    others = np.flatnonzero(ids != asked[a + q])
                    if others.size > k:
                        least = np.partition(mine[others], others.size - k)[others.size - k]
                        more, equal = others[mine[others] > least], others[mine[others] == least]
                        others = np.concatenate([more, equal[: k - more.size]])
                    out += [(int(asked[a + q]), int(ids[c]), int(mine[c])) for c in others]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query row's `k` best other rows; ties go to the smaller vec_id.

    Both tables hold vec_id and embedding (array); a component x counts as floor(`scale` * x), as a long, and shorter
    vectors as if filled up with zeros. Each candidate block meets each query block in one task, that walks the terms:
    a term's weights in the query rows are scattered over its posting list into dense score arrays, of which
    a partition selects the k best. The few best of each block then merge by query. Work is queries times rows, by
    nature; candidates shuffle once for every QUERIES queries.

    Where components are so large that a score may not fit in 64 bits, it raises.

    Rows without vec_id or embedding, and vectors with null or non-finite components, take no part; an
    empty vector scores 0 with all. A candidate with the query's own vec_id is the query's own row, also if repeated;
    repeated query rows give repeated ranks of their common result: they are asked once.
    """
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))

    def ready(frame: DataFrame) -> DataFrame:
        return frame.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("_terms"))

    rows, asked = ready(vectors), ready(queries).dropDuplicates(["vec_id"])
    row_blocks = -(-vectors.count() // CANDIDATES) or 1
    query_blocks = -(-queries.count() // QUERIES) or 1
    rows = rows.withColumn("_row_block", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int")).withColumn("_query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("_query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("_row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    keys = ["_row_block", "_query_block"]
    best = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Score a table of queries against a table of items, block by block.

Items stay where they lie and are never shuffled or copied. Queries are cut into
blocks of checked size; a block is sent to all tasks, each of which streams its
own items past it, as one matrix product per batch, and keeps the best rows per
query. Only those leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.session import materialise

# Scores are compared at this precision, so that equal ones tie.
SCORE_DECIMALS = 9
BLOCK_QUERIES = 1024
BLOCK_BYTES = 64 << 20
# Rows that no hash parts, copies of one id, stay together after so many deals.
MOST_DEALS = 8


class BestScores:
    """The k best (score, item id) per query; equal scores are ordered by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)
        self.kept: pd.DataFrame | None = None

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores as (queries, items); -inf marks an item that does not qualify."""
        if scores.size == 0:
            return
        level = np.round(scores, SCORE_DECIMALS)
        k = min(self.k, level.shape[1])
        kth = np.partition(level, level.shape[1] - k, axis=1)[:, -k]
        floor = np.maximum(kth, self.floor)[:, None]
        query, item = np.nonzero((level >= floor) & (level > -np.inf))
        if len(query) == 0:
            return
        fresh = pd.DataFrame(
            {"query": query, "level": level[query, item], "score": scores[query, item], "id": ids[item]}
        )
        both = fresh if self.kept is None else pd.concat([self.kept, fresh])
        both = both.sort_values(["query", "level", "id"], ascending=[True, False, True])
        self.kept = both.groupby("query", sort=False).head(self.k)
        full = self.kept.groupby("query")["level"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.floor[full.index.to_numpy()] = full["min"].to_numpy()

    def table(self, query_ids: pa.ChunkedArray, schema: pa.Schema) -> pa.Table:
        kept = self.kept
        if kept is None or kept.empty:
            return schema.empty_table()
        ids = query_ids.take(pa.array(kept["query"].to_numpy()))
        columns = [ids, pa.array(kept["id"]), pa.array(kept["score"])]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


Scorer = Callable[[pa.Table], Callable[[pa.Table], np.ndarray]]


def query_blocks(
    queries: DataFrame,
    query_id: str,
    query_bytes: Column,
    max_queries: int = BLOCK_QUERIES,
    max_bytes: int = BLOCK_BYTES,
) -> Iterator[pa.Table]:
    """The queries in blocks of at most `max_queries` rows, of `max_bytes` as well unless a single row has more.

    Rows are dealt by a hash, and a part that came out too large is dealt again, so the driver holds one block at a time.
    """
    todo = [(materialise(queries.withColumn("_bytes", query_bytes)), 0)]
    while todo:
        part, depth = todo.pop()
        rows, size = part.agg(F.count(F.lit(1)), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
        n = max(-(-rows // max_queries), -(-int(size) // max_bytes))
        if n <= 1 or rows <= 1 or depth > MOST_DEALS:
            if rows:
                yield part.drop("_bytes").toArrow()
            continue
        dealt = F.pmod(F.xxhash64(F.lit(depth), query_id), F.lit(n + 1))
        todo += [(part.filter(dealt == i), depth + 1) for i in range(n + 1)]


def scan_items(
    block: pa.Table, items: DataFrame, scorer: Scorer, k: int, query_id: str, item_id: str
) -> DataFrame:
    """The k best items per query of a block in each task, as (query_id, item_id, score); no shuffle."""
    kinds = [T.StructField(query_id, _spark_type(block.schema.field(query_id).type)), items.schema[item_id]]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType())])
    out = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema])
    shared = items.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        score = scorer(shared.value)
        kept = BestScores(shared.value.num_rows, k)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(0, table.num_rows, 2048):
                part = table.slice(at, 2048)
                kept.offer(score(part), part.column(item_id).to_numpy())
        yield from kept.table(shared.value.column(query_id), out).to_batches()

    return items.mapInArrow(scan, schema)


def score_blocks(
    queries: DataFrame,
    items: DataFrame | Callable[[pa.Table], DataFrame],
    scorer: Scorer,
    k: int,
    query_id: str,
    item_id: str,
    query_bytes: Column,
    max_queries: int = BLOCK_QUERIES,
    max_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k best items per query as (query_id, item_id, score, posisi).

    `scorer(queries)` returns a function from an item table to a score matrix. Items may be a function of the block.
    The result is computed here and kept as a table, so that a join to it knows
    how few rows it has, and need not shuffle the table it looks up. A block of
    queries costs one scan of the items.
    """
    found = None
    for block in query_blocks(queries, query_id, query_bytes, max_queries, max_bytes):
        scanned = items(block) if callable(items) else items
        best = best_rows(scan_items(block, scanned, scorer, k, query_id, item_id), query_id, k, *by_score(item_id))
        stored = materialise(best)
        found = stored if found is None else found.unionByName(stored)
    if found is None:
        scanned = items(queries.limit(0).toArrow()) if callable(items) else items
        kinds = [queries.schema[query_id], scanned.schema[item_id]]
        kinds += [T.StructField("score", T.DoubleType()), T.StructField("posisi", T.LongType())]
        return queries.sparkSession.createDataFrame([], T.StructType(kinds))
    return found


def by_score(item_id: str) -> tuple[Column, Column]:
    """Best score first; equal ones by id."""
    return F.desc(F.round("score", SCORE_DECIMALS)), F.asc(item_id)


def best_rows(df: DataFrame, query_id: str, k: int, *order: Column) -> DataFrame:
    """The first k rows per query, numbered in `posisi`."""
    position = F.row_number().over(Window.partitionBy(query_id).orderBy(*order))
    best = df.withColumn("posisi", position).filter(F.col("posisi") <= k)
    return best.withColumn("posisi", F.col("posisi").cast("bigint"))


_TYPES = [(T.LongType(), pa.int64()), (T.IntegerType(), pa.int32()), (T.StringType(), pa.string())]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return dict(_TYPES)[kind] if kind != T.DoubleType() else pa.float64()


def _spark_type(kind: pa.DataType) -> T.DataType:
    return T.StringType() if pa.types.is_large_string(kind) else next(t for t, arrow in _TYPES if arrow == kind)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    joined = column.combine_chunks()
    flat = joined.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(joined), -1).astype(np.float64) if len(joined) else np.zeros((0, 0))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)

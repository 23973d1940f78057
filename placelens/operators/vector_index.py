"""A kept vector index: items stored by cell, whole cells skipped by exact bounds."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.operators.blocks import (
    BLOCK_BYTES,
    BLOCK_QUERIES,
    SCORE_DECIMALS,
    best_rows,
    by_score,
    matrix,
    query_blocks,
    scan_items,
    unit_rows,
)
from placelens.session import materialise

# Rows that fit the centres; every row is indexed.
SAMPLE_ROWS = 20_000
# Most cells, and rows of a file of a cell.
MOST_CELLS = 4096
FILE_ROWS = 250_000
# Distances are rounded; a bound gives way by this much.
SLACK = 1e-6


def fit_centres(vectors: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means from evenly spaced rows; the same rows give the same centres."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)]
    for _ in range(turns):
        nearest = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, unit_rows(sums), centres)
    return np.unique(centres, axis=0)


class VectorIndex:
    """Items in cells around centres, each with the radius that holds all its items, and exact search over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Open a stored index."""
        self.folder = folder.rstrip("/")
        about = json.loads(spark.read.text(f"{self.folder}/about", wholetext=True).first()[0])
        self.item_id, self.embedding = about["item_id"], about["embedding"]
        self.items = spark.read.schema(about["schema"]).parquet(f"{self.folder}/items")
        rows = spark.read.parquet(f"{self.folder}/cells").orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in rows], dtype=np.int64)
        self.centres = np.array([r["centre"] for r in rows], dtype=np.float64)
        self.radius, self.count = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])

    @classmethod
    def build(
        cls,
        vectors: DataFrame,
        folder: str,
        item_id: str = "id",
        embedding: str = "embedding",
        cells: int | None = None,
        sample: int = SAMPLE_ROWS,
    ) -> VectorIndex:
        """Store an index of all rows with a vector; ids and vectors are kept as they are given.

        Centres are fitted on at most `sample` rows, chosen by a hash of the vector. Then each row goes to its
        nearest centre; a cell with many rows is written in several files. Vectors of length zero lie
        around the origin like the others. An empty table gives an index without cells.
        """
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        rows = vectors.select(item_id, embedding).filter(F.col(embedding).isNotNull())
        n = rows.count()
        cells = min(cells or int(n**0.5) + 1, MOST_CELLS)
        drawn = rows if n <= sample else rows.orderBy(F.xxhash64(embedding), item_id).limit(sample)
        chosen = drawn.orderBy(item_id).select(embedding).toArrow().column(0)
        centres = fit_centres(unit_rows(matrix(chosen)), cells) if n else np.zeros((0, 1))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    unit = unit_rows(matrix(pa.chunked_array([part.column(1)])))
                    cell = (unit @ centres.T).argmax(axis=1)
                    apart = np.linalg.norm(unit - centres[cell], axis=1)
                    columns = [*part.columns, pa.array(cell, pa.int64()), pa.array(apart, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, [item_id, embedding, "cell", "apart"])

        kinds = dict(rows.dtypes)
        placed = rows.mapInArrow(place, f"`{item_id}` {kinds[item_id]}, `{embedding}` {kinds[embedding]}, cell long, apart double")
        placed = materialise(placed)
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"))
        centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell long, centre array<double>")
        sizes.join(F.broadcast(centre), "cell").write.parquet(f"{folder}/cells")
        files = sizes.select("cell", F.ceil(F.col("n") / FILE_ROWS).alias("files"))
        part = F.pmod(F.xxhash64(item_id), F.col("files"))
        dealt = placed.join(F.broadcast(files), "cell").withColumn("part", part)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FILE_ROWS + 1)
        dealt.repartition(parts, "cell", "part").drop("apart", "files", "part").write.partitionBy("cell").parquet(f"{folder}/items")
        schema = f"`{item_id}` {kinds[item_id]}, `{embedding}` {kinds[embedding]}, cell long"
        about = json.dumps({"item_id": item_id, "embedding": embedding, "schema": schema})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{folder}/about")
        return cls(spark, folder)

    def items_of(self, cells: np.ndarray) -> DataFrame:
        """The items of some cells; the files of others are not read."""
        return self.items.filter(F.col("cell").isin([int(self.cells[c]) for c in cells]))

    def _scan(self, block: pa.Table, wanted: np.ndarray, k: int, query_id: str, embedding: str) -> DataFrame:
        """The best items per query among the wanted cells, a matrix of (query, cell)."""
        number, item_embedding = {int(c): i for i, c in enumerate(self.cells)}, self.embedding

        def scorer(queries: pa.Table):
            left = unit_rows(matrix(queries.column(embedding)))

            def score(items: pa.Table) -> np.ndarray:
                scores = left @ unit_rows(matrix(items.column(item_embedding))).T
                at = np.array([number[c] for c in items.column("cell").to_pylist()])
                return np.where(wanted[:, at], scores, -np.inf)

            return score

        found = scan_items(block, self.items_of(np.flatnonzero(wanted.any(axis=0))), scorer, k, query_id, self.item_id)
        return materialise(best_rows(found, query_id, k, *by_score(self.item_id)).drop("posisi"))

    def topk(
        self,
        queries: DataFrame,
        k: int = 20,
        query_id: str = "query_id",
        embedding: str = "embedding",
        max_queries: int = BLOCK_QUERIES,
        max_bytes: int = BLOCK_BYTES,
    ) -> DataFrame:
        """The k nearest items per query by cosine, as vector_topk over all items: (query_id, id, similarity_score, posisi).

        First a query meets its nearest cells, as many as hold k items; its k-th
        score there is a floor. No item of a cell is nearer than the centre's
        distance less the radius, so cells that cannot reach the floor are
        skipped, with their files, and the others are read. Rows of one query id
        are one query; queries without a vector are left out.
        """
        asked = queries.select(query_id, embedding).filter(F.col(embedding).isNotNull())
        found = None
        if not len(self.cells):
            asked = asked.limit(0)
        for block in query_blocks(asked, query_id, 8 * F.size(embedding), max_queries, max_bytes):
            unit = unit_rows(matrix(block.column(embedding)))
            squares = (unit**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * unit @ self.centres.T
            distance = np.sqrt(np.maximum(squares, 0))
            order = distance.argsort(axis=1)
            before = np.cumsum(self.count[order], axis=1) - self.count[order]
            first = np.zeros(distance.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            near = self._scan(block, first, k, query_id, embedding)
            kth = near.groupBy(query_id).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).collect()
            floors = {r[query_id]: r["floor"] for r in kth if r["n"] >= k}
            floor = np.array([floors.get(q, -np.inf) for q in block.column(query_id).to_pylist()])
            # |q - x|^2 = 2 - 2 cos for unit vectors; for a vector of length zero the cosine is 0 and the bound not lower.
            reach = 1 - np.maximum(distance - self.radius - SLACK, 0) ** 2 / 2
            more = (np.round(reach + SLACK, SCORE_DECIMALS) >= np.round(floor, SCORE_DECIMALS)[:, None]) & ~first
            if more.any():
                near = near.unionByName(self._scan(block, more, k, query_id, embedding))
            stored = materialise(best_rows(near, query_id, k, *by_score(self.item_id)))
            found = stored if found is None else found.unionByName(stored)
        if found is None:
            kinds, own = dict(asked.dtypes), dict(self.items.dtypes)
            schema = f"`{query_id}` {kinds[query_id]}, `{self.item_id}` {own[self.item_id]}, score double, posisi long"
            found = asked.sparkSession.createDataFrame([], schema)
        return found.withColumnRenamed("score", "similarity_score")

"""A kept keyword index: postings in bands of weight, lists and bands skipped by exact bounds."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions.text import tokens
from placelens.operators.blocks import best_rows, by_score, score_blocks
from placelens.operators.skew import skew_safe_join
from placelens.operators.tfidf import MIN_SCORE, build_tfidf, place_results, sparse_scorer, tfidf_vectors
from placelens.session import materialise

# Postings of a file, and most buckets of terms.
FILE_ROWS = 4_000_000
MOST_BUCKETS = 4096
# A weight half as large lies this many bands lower; what is smaller than the last band is in it.
BANDS_PER_HALVING = 8
LAST_BAND = 255
# Rows and bytes of wanted bands that are broadcast at a time.
BLOCK_ROWS = 200_000
BLOCK_BYTES = 32 << 20
# A query with more wanted postings than 1/SCAN_SHARE of the texts is scanned past the stored vectors instead.
SCAN_SHARE = 50
# Scores are sums in any order; a bound gives way by this much.
SLACK = 1e-8


def band_of(weight: Column) -> Column:
    """0 for the largest weights (1), one more for every step down."""
    band = F.floor(F.log2(weight) * -BANDS_PER_HALVING)
    return F.least(F.greatest(band, F.lit(0)), F.lit(LAST_BAND)).cast("int")


def _list_schema(vectors: DataFrame) -> T.StructType:
    items = T.StructField("items", T.ArrayType(vectors.schema["item"].dataType))
    return T.StructType([T.StructField("term", T.StringType()), items, vectors.schema["weights"]])


def _term_lists(batches):
    """From vectors (item, terms, weights) to (term, items, weights), a row per batch and term."""
    for batch in batches:
        item, terms, weights = (batch.column(c) for c in ("item", "terms", "weights"))
        row = np.repeat(np.arange(len(item)), terms.value_lengths().to_numpy(zero_copy_only=False))
        coded = terms.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        moved = item.take(pa.array(row[order])), weights.flatten().take(pa.array(order))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in moved]
        yield pa.RecordBatch.from_arrays([coded.dictionary, *lists], names=["term", "items", "weights"])


class KeywordIndex:
    """Unit TF-IDF vectors of a review table as stored postings, and exact search over them.

    Three tables lie in the folder. `vectors` is (item, terms, weights), for queries whose bounds leave much to read. `postings` is (bucket, term, band, item, weight), by bucket of terms; `terms` is
    (bucket, term, df, idf, bands), with the largest weight and the number of postings of each of a term's bands.
    No row holds a whole list, so a word of every text is many rows in many files.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        """Open a stored index."""
        self.folder = folder.rstrip("/")
        about = json.loads(spark.read.text(f"{self.folder}/about", wholetext=True).first()[0])
        self.item_id, self.texts, self.buckets = about["item_id"], about["texts"], about["buckets"]
        self.postings = spark.read.schema(about["postings"]).parquet(f"{self.folder}/postings")
        self.terms = spark.read.schema(about["terms"]).parquet(f"{self.folder}/terms")
        self.vectors = spark.read.schema(about["vectors"]).parquet(f"{self.folder}/vectors")

    @classmethod
    def build(
        cls,
        reviews: DataFrame,
        folder: str,
        item_id: str = "id",
        text: str = "teks_mentah",
        buckets: int | None = None,
    ) -> KeywordIndex:
        """Store an index of all reviews with a text, weighted as build_tfidf does.

        Null and empty texts are left out, as are texts without tokens; rows of one id are one text. A text without
        an id counts for the weights but cannot be found. An empty table gives an index without postings. The
        folder must be new.
        """
        spark, folder = reviews.sparkSession, folder.rstrip("/")
        tfidf = build_tfidf(reviews.select(F.col(item_id).alias("item"), F.col(text).alias("text")), "item", "text")
        if buckets is None:
            buckets = min(MOST_BUCKETS, tfidf.vocabulary.count() // 256 + 1)
        vectors = tfidf.vectors.filter(F.col("item").isNotNull())
        vectors.write.parquet(f"{folder}/vectors", compression="zstd")
        vectors = spark.read.schema(vectors.schema).parquet(f"{folder}/vectors")
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")

        # A bucket with many postings is written in several files, each sorted so that bands lie together.
        per_bucket = tfidf.vocabulary.groupBy(bucket).agg(F.sum("df").alias("n"))
        files = materialise(per_bucket.select("bucket", F.ceil(F.col("n") / FILE_ROWS).alias("files"), "n"))
        total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // FILE_ROWS + 1)
        # Postings of a term move together, those of one batch of texts in a row.
        lists = vectors.mapInArrow(_term_lists, _list_schema(vectors)).select(bucket, "*")
        dealt = lists.join(F.broadcast(files.drop("n")), "bucket")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("term", "items"), F.col("files"))).drop("files")
        entry = F.explode(F.arrays_zip("items", "weights"))
        rows = dealt.repartition(parts, "bucket", "part").select("bucket", "part", "term", entry.alias("_entry"))
        item, weight = F.col("_entry.items").alias("item"), F.col("_entry.weights").alias("weight")
        rows = rows.select("bucket", "term", band_of(F.col("_entry.weights")).alias("band"), item, weight)
        rows.sortWithinPartitions("bucket", "term", "band").write.partitionBy("bucket").parquet(f"{folder}/postings", compression="zstd")
        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("term", "band", "item", "weight", "bucket"))

        # A term has at most LAST_BAND + 1 bands; bands lie together in the files, so few sums leave a task.
        stored = spark.read.schema(schema).parquet(f"{folder}/postings")
        sizes = stored.groupBy("bucket", "term", "band").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
        band = F.when(F.col("band").isNotNull(), F.struct("top", "band", "n"))
        weighed = tfidf.vocabulary.select(bucket, "term", "df", "idf")
        dealt = sizes.unionByName(weighed, allowMissingColumns=True).repartitionByRange("bucket")
        listed = F.sort_array(F.collect_list(band), asc=False).alias("bands")
        terms = dealt.groupBy("bucket", "term").agg(F.max("df").alias("df"), F.max("idf").alias("idf"), listed)
        terms = terms.filter(F.size("bands") > 0)
        terms.sortWithinPartitions("bucket", "term").write.parquet(f"{folder}/terms")
        about = {
            "item_id": item_id,
            "texts": tfidf.texts,
            "buckets": buckets,
            "postings": schema,
            "terms": ", ".join(f"{c} {t}" for c, t in terms.dtypes),
            "vectors": ", ".join(f"{c} {t}" for c, t in vectors.dtypes),
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/about")
        return cls(spark, folder)

    def postings_of(self, buckets: list[int]) -> DataFrame:
        """The postings of some buckets of terms; the files of others are not read."""
        return self.postings.filter(F.col("bucket").isin(buckets))

    def _sums(self, wanted: DataFrame) -> DataFrame:
        """(query_id, item, score) over the wanted (query_id, bucket, term, band, w), a stored table.

        Wanted bands are dealt into blocks of checked size; each is broadcast to the postings where they lie.
        """
        size = F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))
        rows, width, buckets = wanted.agg(F.count(F.lit(1)), size, F.collect_set("bucket")).first()
        n = max(rows // BLOCK_ROWS, width // BLOCK_BYTES) + 1
        deal = F.pmod(F.xxhash64("query_id", "term", "band"), F.lit(n))
        asked = wanted.select("query_id", "term", "band", "w")
        found = [
            self.postings_of(buckets)
            .join(F.broadcast(asked.filter(deal == i)), ["term", "band"])
            .select("query_id", "item", (F.col("w") * F.col("weight")).alias("score"))
            for i in range(n)
        ]
        return reduce(DataFrame.unionAll, found).groupBy("query_id", "item").agg(F.sum("score").alias("score"))

    def _lists(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, w, reach, bucket, bands): the known terms of the queries with their lists.

        `w` is the term's weight in the query's unit vector, `reach` the most that the list can add to a score.
        """
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        asked = queries.select(F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        numbers = [r[0] for r in asked.select(bucket.alias("bucket")).distinct().collect()]
        known = self.terms.filter(F.col("bucket").isin(numbers))
        entry = F.explode(F.arrays_zip("terms", "weights"))
        words = materialise(
            tfidf_vectors(queries, known, "query_id", "query")
            .select("query_id", entry.alias("_entry"))
            .select("query_id", F.col("_entry.terms").alias("term"), F.col("_entry.weights").alias("w"))
        )
        lists = skew_safe_join(words, known.select("term", "bucket", "bands"), "term", F.xxhash64("query_id"))
        return materialise(lists.withColumn("reach", F.col("w") * F.col("bands")[0]["top"]))

    def topk(self, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "query") -> DataFrame:
        """The k best items per query by cosine, as a scan of all texts gives them: (query_id, id, score, posisi).

        First the bands that can add most, with 4k postings a query, give k items; the least of their whole
        scores is a floor. Lists ordered by reach that together stay below the floor cannot lift an item over it
        by themselves, so items come from the other lists alone, and of those only from bands that reach the
        floor with all that the other lists can add. Items still in reach then take what the small lists add,
        by term and item.

        Where the bounds of a query leave more postings than a share of the texts, as with many words of like
        weight, it is scored against the stored vectors, where they lie, together with others like it. What is broadcast is cut to a checked size. Scores below MIN_SCORE do not
        qualify. Queries that are null or without known terms have no rows; rows of one query id are one
        query; equal scores (to 9 decimals) are ordered by item id.
        """
        lists = self._lists(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("query")))
        inlined = lists.select("query_id", "bucket", "term", "w", "reach", F.inline("bands"))
        gain = F.col("w") * F.col("top")
        # Any bands give a floor; none of these is large.
        inlined = inlined.filter(F.col("n") <= max(4 * k, self.texts // max(1, SCAN_SHARE)))
        by_gain = Window.partitionBy("query_id").orderBy(gain.desc(), "term", "band")
        before = F.coalesce(F.sum("n").over(by_gain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        heads = materialise(inlined.withColumn("_before", before).filter(F.col("_before") < 4 * k))
        first = materialise(best_rows(self._sums(heads), "query_id", k, F.desc("score")).select("query_id", "item"))
        whole = self._looked_up(first, lists).groupBy("query_id", "item").agg(F.sum("score").alias("score"))
        kth = whole.groupBy("query_id").agg(F.min("score").alias("_kth"), F.count(F.lit(1)).alias("_n"))
        kth = kth.filter(F.col("_n") == k).select(F.col("query_id").alias("_query"), "_kth")

        floored = lists.join(kth, F.col("query_id").eqNullSafe(F.col("_query")), "left")
        floor = F.greatest(F.coalesce("_kth", F.lit(MIN_SCORE)), F.lit(MIN_SCORE)) - SLACK
        query = Window.partitionBy("query_id")
        upwards = query.orderBy("reach", "term").rowsBetween(Window.unboundedPreceding, 0)
        small = F.col("_upto") < F.col("floor")
        bounded = materialise(
            floored.select(lists["*"], floor.alias("floor"))
            .withColumn("_upto", F.sum("reach").over(upwards))
            .withColumn("total", F.sum("reach").over(query))
            .withColumn("small", small)
            .withColumn("spare", F.max(F.when(small, F.col("_upto")).otherwise(F.lit(0.0))).over(query))
        )
        large = bounded.filter(~F.col("small")).select(
            "query_id", "bucket", "term", "w", "floor", (F.col("total") - F.col("reach")).alias("_others"), F.inline("bands")
        )
        wanted = materialise(large.filter(gain + F.col("_others") >= F.col("floor")))
        load = wanted.groupBy("query_id").agg(F.sum("n").alias("n"))
        heavy = materialise(load.filter(F.col("n") * SCAN_SHARE > self.texts).select(F.col("query_id").alias("_heavy")))
        is_heavy = F.col("query_id").eqNullSafe(F.col("_heavy"))
        scanned = self._scanned(lists.join(heavy, is_heavy, "left_semi"), k)
        wanted = materialise(wanted.join(heavy, is_heavy, "left_anti"))
        limits = bounded.groupBy("query_id").agg(F.first("floor").alias("floor"), F.first("spare").alias("spare"))
        limits = limits.withColumnRenamed("query_id", "_query")
        part = self._sums(wanted).join(limits, F.col("query_id").eqNullSafe(F.col("_query")))
        part = materialise(
            part.filter(F.col("score") + F.col("spare") >= F.col("floor")).select("query_id", "item", "score")
        )
        scores = part.unionByName(self._looked_up(part, bounded.filter("small")))
        scores = scores.groupBy("query_id", "item").agg(F.sum("score").alias("score"))
        scores = scores.filter(F.col("score") >= MIN_SCORE)
        best = materialise(best_rows(scores, "query_id", k, *by_score("item")))
        return best.unionByName(scanned).select(F.col("query_id").alias(query_id), F.col("item").alias(self.item_id), "score", "posisi")

    def _scanned(self, lists: DataFrame, k: int) -> DataFrame:
        """(query_id, item, score, posisi): queries past all stored vectors, in blocks."""
        # A group is one query, so its list is no longer than the query.
        pairs = lists.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("_pairs"))
        asked = pairs.select("query_id", F.col("_pairs.term").alias("terms"), F.col("_pairs.w").alias("weights"))
        size = F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t) + 16)
        return score_blocks(asked, self.vectors, sparse_scorer, k, "query_id", "item", size)

    def _looked_up(self, items: DataFrame, lists: DataFrame) -> DataFrame:
        """(query_id, item, score): what each list of a query adds to its items. Term and item name one posting."""
        buckets = [r[0] for r in lists.select("bucket").distinct().collect()]
        asked = lists.select(F.col("query_id").alias("_query"), F.col("term").alias("_term"), "w")
        pairs = items.join(asked, F.col("query_id").eqNullSafe(F.col("_query"))).select(
            "query_id", F.col("item").alias("_item"), "_term", "w"
        )
        per_query = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("_items"))
        counts = asked.groupBy("_query").agg(F.count(F.lit(1)).alias("_lists"))
        met = per_query.join(counts, F.col("query_id").eqNullSafe(F.col("_query")))
        # Few pairs are sent to the postings where they lie; more are too many to hold, and are shuffled like them.
        if (met.agg(F.sum(F.col("_items") * F.col("_lists"))).first()[0] or 0) <= BLOCK_ROWS:
            pairs = F.broadcast(pairs)
        same = (F.col("term") == F.col("_term")) & (F.col("item") == F.col("_item"))
        added = (F.col("w") * F.col("weight")).alias("score")
        return self.postings_of(buckets).join(pairs, same).select("query_id", "item", added)


def indexed_search(queries: DataFrame, reviews: DataFrame, index: KeywordIndex, k: int = 5) -> DataFrame:
    """tfidf_search through a kept index of the reviews, which are read only for the rows that are shown."""
    return place_results(index.topk(queries, 5 * k), reviews, k, 2)

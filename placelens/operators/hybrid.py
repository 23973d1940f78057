"""Hybrid search: word-vector similarity, whole-phrase hits and name hits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.functions import fixed_values as fixed
from placelens.functions.arrow_text import keyword_texts, lists_by_row, map_slices, positions, text_words
from placelens.functions.text import clean_keywords
from placelens.operators.blocks import matrix, score_blocks, unit_rows
from placelens.operators.phrases import PhraseFinder
from placelens.operators.skew import most_frequent
from placelens.operators.tfidf import place_results, usable_reviews
from placelens.operators.words import word_counts
from placelens.session import materialise

MIN_SCORE = 0.01
# Word vectors that every worker holds, in bytes; of larger models those of the most frequent words.
MODEL_BYTES = 16 << 20


@dataclass
class WordModel:
    """Word vectors ready for use: shared with all workers if small enough, else as a table."""

    dim: int
    table: DataFrame
    shared: Broadcast | None
    model_bytes: int = MODEL_BYTES


def load_words(word_vectors: DataFrame, model_bytes: int = MODEL_BYTES) -> WordModel | None:
    """A model from (word, vector); None for an empty one."""
    rows, dim, chars = word_vectors.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.sum(F.octet_length("word"))
    ).first()
    if not rows:
        return None
    small = rows * dim * 8 + chars <= model_bytes
    context = word_vectors.sparkSession.sparkContext
    shared = context.broadcast(word_vectors.toArrow()) if small else None
    return WordModel(dim, word_vectors, shared, model_bytes)


def mean_vectors(texts: DataFrame, key: str, text: str, model: WordModel) -> DataFrame:
    """Adds `vector`: the mean of the vectors of a text's known words; zeros if it has none. Keys may repeat."""
    numbered = number_rows(texts)
    return numbered.join(row_vectors(numbered, text, model), "_row").select(*texts.columns, "vector")


def number_rows(texts: DataFrame) -> DataFrame:
    """Stores the texts with `_row`, which no other row has; what is computed for a text is joined by it."""
    return materialise(texts.withColumn("_row", F.monotonically_increasing_id()))


def row_vectors(numbered: DataFrame, text: str, model: WordModel) -> DataFrame:
    """(_row, vector): the mean of the vectors of the known words of every row; stored.

    Of a model that is too large to share, the words most frequent in the texts are shared. The others, few of the
    words of a text, meet their vectors by a shuffle. Texts are split where they lie; only sums and rare words move.
    """
    known, shared = None, model.shared
    if shared is None:
        counts = word_counts(numbered, text).withColumnRenamed("n", "_rows")
        known = materialise(model.table.select("word", "vector").join(counts, "word"))
        hot = most_frequent(known, "_rows", F.octet_length("word") + 8 * model.dim, model.model_bytes)
        shared = numbered.sparkSession.sparkContext.broadcast(known.filter(hot).select("word", "vector").toArrow())
    sums = _sums_by_lookup(numbered, text, shared, model.dim, known is not None)
    every, n = F.array("_sum"), F.col("_n")
    if known is not None:
        sums = materialise(sums)
        rare = sums.select("_row", F.explode("_rare").alias("word")).join(known.filter(~hot), "word")
        # A group is one text, so its list is no longer than the text.
        rare = rare.groupBy("_row").agg(F.collect_list(F.col("vector").cast("array<double>")).alias("_vectors"))
        sums = sums.drop("_rare").join(rare, "_row", "left")
        more = F.coalesce("_vectors", F.array().cast("array<array<double>>"))
        every, n = F.concat(every, more), n + F.size(more)
    zeros = F.array_repeat(F.lit(0.0), model.dim)
    total = F.aggregate(every, zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return materialise(sums.select("_row", F.transform(total, lambda x: x / F.greatest(n, F.lit(1))).alias("vector")))


def _sums_by_lookup(numbered: DataFrame, text: str, shared: Broadcast, dim: int, with_rare: bool) -> DataFrame:
    """(_row, _sum, _n, _rare): per row the sum and number of its shared words, and its other words if asked for.

    Shared vectors, of checked size, are on every worker; the texts are not shuffled.
    """
    schema = "_row bigint, _sum array<double>, _n bigint" + ", _rare array<string>" * with_rare

    def start():
        known = shared.value.column("word").combine_chunks()
        vectors = matrix(shared.value.column("vector"))

        def add_up(part):
            rows = part.num_rows
            row, said = text_words(part.column(text))
            at = positions(said, known)
            sums, counts = np.zeros((rows, dim)), np.bincount(row[at >= 0], minlength=rows)
            for i, here in enumerate(np.split(at, np.searchsorted(row, np.arange(1, rows)))):
                if counts[i]:
                    sums[i] = vectors[here[here >= 0]].sum(axis=0)
            flat = np.repeat(np.arange(rows), dim)
            columns = [part.column("_row"), lists_by_row(flat, pa.array(sums.ravel()), rows), pa.array(counts)]
            if with_rare:
                columns.append(lists_by_row(row[at < 0], said.filter(pa.array(at < 0)), rows))
            return pa.RecordBatch.from_arrays(columns, names=["_row", "_sum", "_n", "_rare"][: len(columns)])

        return add_up

    return map_slices(numbered.select("_row", text), text, schema, start)


def phrase_scorer(queries: pa.Table):
    """Points of items (clean, name) for the phrases they hold, as a matrix."""
    phrases = PhraseFinder(queries.column("clean").to_pylist())
    w = fixed.HYBRID_WEIGHTS

    def score(items: pa.Table) -> np.ndarray:
        total = w["text"] * phrases.hits(items.column("clean").to_pylist())
        return total + w["name"] * phrases.hits(items.column("name").to_pylist())

    return score


def phrase_points(queries: pa.Table, texts: DataFrame) -> DataFrame:
    """(_row, id, _query, _points): the queries of a block that a text has points for, and how many; no shuffle."""
    lists = [("_query", T.IntegerType()), ("_points", T.DoubleType())]
    kinds = [T.StructField("_row", T.LongType()), texts.schema["id"], *[T.StructField(n, T.ArrayType(t)) for n, t in lists]]
    schema = T.StructType(kinds)
    names = schema.names
    shared = texts.sparkSession.sparkContext.broadcast(queries.select(["clean"]))

    def start():
        score = phrase_scorer(shared.value)

        def find(part):
            found = []
            for at in range(0, part.num_rows, 1024):
                points = score(pa.Table.from_batches([part.slice(at, 1024)])).T
                row, query = np.nonzero(points)
                found.append((row + at, query.astype(np.int32), points[row, query]))
            row, *values = map(np.concatenate, zip(*found))
            lists = [lists_by_row(row, pa.array(x), part.num_rows) for x in values]
            return pa.RecordBatch.from_arrays([part.column("_row"), part.column("id"), *lists], names=names)

        return find

    return map_slices(texts.select("_row", "id", "clean", "name"), "clean", schema, start)


def hybrid_scorer(semantic: bool):
    """Scores of items with their texts or, if semantic, with the points of phrase_points and a vector."""

    def prepare(queries: pa.Table):
        points = None if semantic else phrase_scorer(queries)
        left = unit_rows(matrix(queries.column("vector"))) if semantic else None

        def score(items: pa.Table) -> np.ndarray:
            if semantic:
                total = fixed.HYBRID_WEIGHTS["semantic"] * (left @ unit_rows(matrix(items.column("vector"))).T)
                query = items.column("_query").combine_chunks()
                row = np.repeat(np.arange(items.num_rows), query.value_lengths().to_numpy(zero_copy_only=False))
                total[query.flatten().to_numpy(), row] += items.column("_points").combine_chunks().flatten().to_numpy()
            else:
                total = points(items)
            return np.where(total > MIN_SCORE, total, -np.inf)

        return score

    return prepare


def hybrid_search(
    queries: DataFrame, reviews: DataFrame, word_vectors: DataFrame | None = None, k: int = 20, **blocks
) -> DataFrame:
    """The k best places per query, as in the keyword search; without word vectors only phrase and name count.

    The best 2k reviews are cut before the best one per place is kept. With word vectors the texts are cleaned and
    stored once; a block of queries costs one scan of them, and what it finds meets the vectors by row.
    """
    usable = usable_reviews(reviews, "teks_mentah")
    asked = queries.select("query_id", clean_keywords(F.coalesce("query", F.lit(""))).alias("clean"))
    size = F.octet_length("clean") + 16
    model = load_words(word_vectors) if word_vectors is not None else None
    if model is None:
        known = usable.select("id", clean_keywords(F.col("teks_mentah")).alias("clean"), F.lower("nama").alias("name"))
        found = score_blocks(asked, known, hybrid_scorer(False), 2 * k, "query_id", "id", size, **blocks)
        return place_results(found, reviews, k, 1)
    asked = mean_vectors(asked, "query_id", "clean", model)
    known = number_rows(cleaned_texts(usable.select("id", F.col("teks_mentah").alias("clean"), F.lower("nama").alias("name"))))
    vectors = row_vectors(known, "clean", model)
    # Stored, so that no task needs the workers of two steps at a time.
    items = lambda block: materialise(phrase_points(block, known)).join(vectors, "_row").drop("_row")
    size = size + 8 * F.size("vector")
    found = score_blocks(asked, items, hybrid_scorer(True), 2 * k, "query_id", "id", size, **blocks)
    return place_results(found, reviews, k, 1)


def cleaned_texts(texts: DataFrame) -> DataFrame:
    """The texts with `clean` as clean_keywords makes it."""

    def clean(part):
        return part.set_column(part.schema.get_field_index("clean"), "clean", keyword_texts(part.column("clean")))

    return map_slices(texts, "clean", texts.schema, lambda: clean)


def search_summary(queries: DataFrame, results: DataFrame, name: str = "nama") -> DataFrame:
    """Per query: its cleaned form, the number of results and the best one."""
    first = results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("jumlah_hasil"), F.min_by(name, "rank").alias("hasil_teratas")
    )
    return queries.join(first, "query_id", "left").select(
        "query_id",
        F.col("query").alias("query_user"),
        clean_keywords(F.coalesce("query", F.lit(""))).alias("query_bersih"),
        F.coalesce("jumlah_hasil", F.lit(0)).cast("bigint").alias("jumlah_hasil"),
        F.coalesce("hasil_teratas", F.lit(fixed.NO_RESULT)).alias("hasil_teratas"),
    )

"""Document fingerprints: mergeable bottom-k sketches of word shingles, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.llm.common import materialise, numbered, text_of, words_of

# Words in a shingle, and hashes that a sketch retains.
WORDS = 5
SIZE = 64


def with_sketch(df: DataFrame, text: str, out: str, words: int = WORDS, size: int = SIZE) -> DataFrame:
    """Add the `size` least hashes of a non-null text's distinct shingles, ascending.

    A text with fewer words is one shingle, one without words has an empty
    sketch. A sketch with fewer than `size` hashes is the whole set.
    """
    hashes, runs = f"_{out}_words", f"_{out}_runs"
    firsts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (words - 1), F.lit(1)))
    run = lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, words)])
    return (
        df.withColumn(hashes, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn(runs, F.transform(firsts, run))
        .withColumn(out, F.slice(F.sort_array(F.array_distinct(runs)), 1, size))
        .drop(hashes, runs)
    )


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def _shared(a: Column, b: Column, size: int) -> Column:
    return F.size(F.array_intersect(merged(a, b, size), F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A or B|, from the sketch of the union; 1 for two empty sets."""
    union = F.size(merged(a, b, size))
    return F.when(union == 0, F.lit(1.0)).otherwise(_shared(a, b, size) / union)


def distinct_count(sketch: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below `size`."""
    share = (F.get(sketch, F.lit(size - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of |A and B| / |A|; 1 for an empty A."""
    both = resemblance(a, b, size) * distinct_count(merged(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(both / distinct_count(a, size), F.lit(1.0)))


def merge_sketches(df: DataFrame, keys: list[str], sketch: str, size: int = SIZE) -> DataFrame:
    """One sketch per key: that of all its rows' sets together.

    Hashes collapse before the shuffle, and each task passes on the `size` least per key.
    """
    hashes = df.select(*keys, F.explode(sketch).alias("_hash")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    least = hashes.withColumn("_place", place).filter(F.col("_place") <= size)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(sketch))


def fingerprint(sketch: Column) -> Column:
    """The sketch as text: hashes in hex, separated by dots."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ".")


def fingerprint_edits(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per document: its sketch, its edited text's, and how much they and the next document's are alike.

    The edit replaces the last half of a text's code points by the first as many
    of the next document's (ascending id; the first follows the last). Columns:
    doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited,
    near_next.

    Documents are numbered without their texts. Then every text moves once, with
    its sketch, and the head that its predecessor needs once more.

    A null text counts as empty. A null id comes first. Rows of one id with
    different texts follow each other in a fixed order; rows alike in both are
    one document and give the same result each. A single document follows
    itself. An empty table gives an empty one; other columns are not read.
    """
    ident = F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("-"))
    keyed = docs.select(F.col(id_column).alias("doc_id"), ident.alias("_id"), text_of(F.col(text_column)).alias("text"))
    key = F.unhex(F.md5(F.concat("_id", F.lit(":"), F.md5("text"))))
    keyed = keyed.withColumn("_k", key)
    thin = keyed.select("_k", "doc_id", F.length("text").cast("bigint").alias("n_chars"))
    thin = materialise(thin.groupBy("_k").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars")))
    n = thin.count()
    placed = materialise(numbered(thin, ["doc_id", "_k"], "_n"))
    before = placed.select(
        F.pmod(F.col("_n") + 1, F.lit(max(n, 1))).alias("_n"),
        F.col("_k").alias("_before"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("_head"),
    )
    order = materialise(placed.join(before, "_n").select("_k", "doc_id", "n_chars", "_before", "_head"))
    # Both sides of the join read the same shuffle: a key, a text and its sketch.
    moved = with_sketch(keyed.select("_k", "text"), "text", "sketch")
    own = moved.join(order.select("_k", "doc_id", "n_chars"), "_k")
    heads = moved.join(order.select("_k", "_before", "_head"), "_k").select(
        F.col("_before").alias("_k"),
        F.left("text", F.col("_head")).alias("_next_head"),
        F.col("sketch").alias("_next_sketch"),
    )
    heads = heads.groupBy("_k").agg(F.first("_next_head").alias("_next_head"), F.first("_next_sketch").alias("_next_sketch"))
    kept = F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    edited = own.join(heads, "_k").withColumn("_edited", F.concat(kept, F.col("_next_head")))
    done = with_sketch(edited, "_edited", "edited_sketch")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_next_sketch")).alias("near_next"),
    )

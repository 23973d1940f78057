"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio of trusted text against all text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import materialise, text_of, words_of

# N-grams are all runs of up to so many words, hashed together into so many buckets.
NGRAM = 2
BUCKETS = 1 << 18
# Added to the count of each bucket in both multinomials, once the raw one is scaled to the trusted one's size.
SMOOTHING = 5.0
# A document is kept if its mean log ratio per n-gram, in nats, is at least this.
THRESHOLD = -0.15
# At most about this many trusted documents fit the target multinomial.
TRUSTED_ROWS = 200_000

BASE_COLUMNS = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _longer(runs: Column, hashes: Column, size: int) -> Column:
    """Hash of each run of `size` words, from those of the runs of one word less and of the words."""
    n = F.greatest(F.size(hashes) - (size - 1), F.lit(0))
    return F.zip_with(F.slice(runs, 1, n), F.slice(hashes, size, n), lambda run, last: F.xxhash64(run, last))


def _with_runs(docs: DataFrame, longest: int) -> DataFrame:
    """Add `_runs2` to `_runs<longest>`, the hashes of all runs of so many words, to a table with `_hashes`."""
    for size in range(2, longest + 1):
        shorter = "_hashes" if size == 2 else f"_runs{size - 1}"
        docs = docs.withColumn(f"_runs{size}", _longer(F.col(shorter), F.col("_hashes"), size))
    return docs


def _ngrams(longest: int) -> Column:
    """Hashes of all runs of 1 to `longest` words, from the columns of _with_runs."""
    return F.concat("_hashes", *[f"_runs{size}" for size in range(2, longest + 1)])


def _repeated_words(windows: Column) -> Column:
    """How many word places lie in 3-word windows that occur twice or more.

    Sorted by whole hash and place, equal windows are neighbours, so a text costs n log n.
    """
    order = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def covered(order: Column) -> Column:
        def same(x: Column, other: Column) -> Column:
            return F.coalesce(x["w"] == F.get(order, other)["w"], F.lit(False))

        again = F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return _size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # A lambda's variable is computed once; a plain column would be computed at each mention.
    count = F.transform(F.array(order), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(count)


def with_counts(docs: DataFrame, text: str, longest: int = 3) -> DataFrame:
    """Add the base columns, the word hashes `_hashes` and those of runs of two to `longest` words to a table with a non-null text."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(text) - F.length(F.regexp_replace(F.col(text), r"[#*$%&|<>]", ""))
    hashed = (
        docs.withColumn("_words", words_of(F.col(text)))
        .withColumn("_lines", lines)
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    )
    counted = (
        _with_runs(hashed, max(3, longest))
        .withColumn("n_words", _size(F.col("_words")))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_symbols", symbols.cast("bigint"))
        .withColumn("n_dup_lines", _size(F.col("_lines")) - _size(F.array_distinct("_lines")))
        .withColumn("n_repeat_words", _repeated_words(F.col("_runs3")))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_words", "_lines")


def trusted_ids(labels: DataFrame, id_column: str, good: Column, bound: int = TRUSTED_ROWS) -> DataFrame:
    """Distinct ids of trusted documents; beyond `bound`, about that many, chosen by a hash of the id."""
    ids = labels.filter(good).select(F.col(id_column).alias("_trusted_id")).dropna().distinct()
    n = ids.count()
    return ids if n <= bound else ids.filter(F.pmod(F.xxhash64("_trusted_id"), F.lit(n)) < bound)


def fit_ratio(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    trusted: DataFrame,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row with `ratios`: per bucket the log of its share in trusted text over its share in all text.

    `trusted` has one bounded column of ids (see trusted_ids) and is broadcast;
    the counts cover every document, and combine before the shuffle to one row
    per bucket and task.
    """
    ids = trusted.toDF("_trusted_id").withColumn("_trusted", F.lit(1))
    texts = docs.select(F.col(id_column).alias("_id"), text_of(F.col(text_column)).alias("_text"))
    flagged = texts.join(F.broadcast(ids), F.col("_id") == F.col("_trusted_id"), "left")
    hashes = F.transform(words_of(F.col("_text")), lambda w: F.xxhash64(w))
    runs = _with_runs(flagged.withColumn("_hashes", hashes), ngram).select("_trusted", F.explode(_ngrams(ngram)).alias("_run"))
    features = runs.select(
        F.coalesce("_trusted", F.lit(0)).alias("_trusted"), F.pmod("_run", F.lit(buckets)).cast("int").alias("b")
    )
    counts = features.groupBy("b").agg(F.sum("_trusted").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select("b", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    # One row of bounded width: an entry per bucket.
    row = full.agg(F.array_sort(F.collect_list(F.struct("b", "t", "r"))).alias("all"), F.sum("t").alias("ts"), F.sum("r").alias("rs"))

    def ratio(x: Column) -> Column:
        expected = F.coalesce(x["r"] * F.col("ts") / F.nullif(F.col("rs"), F.lit(0)), F.lit(0.0))
        return F.log((x["t"] + SMOOTHING) / (expected + SMOOTHING))

    return materialise(row.select(F.transform("all", ratio).alias("ratios")))


def keep_rows(judged: DataFrame) -> DataFrame:
    """The carried rows that are kept.

    The optimizer would push the filter through every step of the counts, and
    copy their expressions each time; it leaves a projection with a
    non-deterministic column in place, which the partition's number is to it.
    """
    held = judged.withColumn("_part", F.spark_partition_id())
    return held.filter((F.col("_part") >= 0) & F.col("kept")).select("_row.*")


def judge_quality(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    model: DataFrame,
    threshold: float = THRESHOLD,
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    carry: bool = False,
) -> DataFrame:
    """One row per document: its id, the base columns, llr (mean log ratio per n-gram) and kept.

    With `carry`, the whole input row comes along as the struct `_row`. A
    document fails the base rules with fewer than 50 words, or with over half of
    its words in repeated 3-word windows; of the others, those with llr >=
    `threshold` are kept. The model, a single row of `buckets` numbers, enters
    as a scalar; scoring is one scan without a shuffle.

    A null or empty text has no words and fails; its llr is 0. Ties at the
    threshold are kept. Repeated rows give repeated results, an empty table an
    empty one, a null id stays null; other columns are not read.
    """
    texts = docs.select(
        F.col(id_column).alias("_id"),
        text_of(F.col(text_column)).alias("_text"),
        *([F.struct("*").alias("_row")] if carry else []),
    )
    add = lambda total, h: total + F.get("_ratios", F.pmod(h, F.lit(buckets)).cast("int"))
    scored = (
        with_counts(texts, "_text", ngram)
        .withColumn("_ratios", model.select("ratios").scalar())
        .withColumn("_runs", _ngrams(ngram))
        .withColumn("_sum", F.aggregate("_runs", F.lit(0.0), add))
    )
    llr = F.when(F.size("_runs") == 0, F.lit(0.0)).otherwise(F.col("_sum") / F.size("_runs"))
    judged = scored.withColumn("llr", llr).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    out = judged.select(F.col("_id").alias(id_column), *BASE_COLUMNS, "llr", "kept", *(["_row"] if carry else []))
    return out

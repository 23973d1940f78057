"""Find texts that hold a pattern by their rarest run of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.operators.skew import skew_safe_join
from placelens.session import materialise

# A pattern whose rarest run is in more than 1/SCAN_SHARE of the texts is better scanned for.
SCAN_SHARE = 50


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text: Column) -> Column:
    """The distinct runs of three characters; none for a shorter or missing text."""

    def of(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - 3)
        every = F.transform(starts, lambda i: F.concat(chars[i], chars[i + 1], chars[i + 2]))
        return F.when(F.size(chars) >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # The characters are bound once; written out inside, they would be split off for every run.
    return F.transform(F.array(F.split(text, "")), of)[0]


def pattern_runs(pattern: Column) -> Column:
    """The runs that every match holds: those of the pieces between wildcards."""
    return F.array_distinct(F.flatten(F.transform(F.split(pattern, "[%_]"), runs)))


def holds(text: Column, pattern: Column) -> Column:
    """Whether a text holds a pattern anywhere; % and _ are wildcards, nothing else is special."""
    pieces = F.split(pattern, "[%_]")
    inner = F.concat(F.lit("%"), F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    # Plain pieces come first, since a wildcard pattern is compiled for each row.
    wild = F.forall(pieces, lambda piece: F.contains(text, piece)) & F.like(text, inner)
    return F.when(F.size(pieces) > 1, wild).otherwise(F.contains(text, pattern))


def postings(texts: DataFrame, text: str) -> DataFrame:
    """The table with a row for every distinct run of a text, in column `_run`."""
    return texts.select("*", F.explode(runs(F.col(text))).alias("_run"))


def rarest_runs(patterns: DataFrame, pattern: str, texts: DataFrame, text: str) -> DataFrame:
    """(pattern, _run, _texts): the run of a pattern that the fewest texts hold, and their number.

    Patterns without a piece of three characters have nulls; a run of no text has 0.
    """
    counts = postings(texts.select(text), text).groupBy("_run").agg(F.count(F.lit(1)).alias("_texts"))
    asked = patterns.select(pattern, F.explode_outer(pattern_runs(F.col(pattern))).alias("_run"))
    found = skew_safe_join(asked, materialise(counts), "_run", F.col(pattern), "left")
    number = F.when(F.col("_run").isNotNull(), F.coalesce("_texts", F.lit(0)))
    least = F.min(F.when(F.col("_run").isNotNull(), F.struct(number.alias("_texts"), "_run"))).alias("_least")
    return found.groupBy(pattern).agg(least).select(pattern, "_least._run", "_least._texts")


def first_holding(
    patterns: DataFrame, pattern: str, texts: DataFrame, text: str, key: str
) -> tuple[DataFrame, DataFrame]:
    """(pattern, key) with the lowest key of a text that holds the pattern, and the patterns that are left to a scan.

    Patterns and texts are stored tables, both distinct and without nulls. A
    pattern meets only the texts with its rarest run, and no more than
    1/SCAN_SHARE of all; patterns beyond that, or without a piece of three
    characters, are left. Texts are checked in the join, and only the lowest key
    of a pattern leaves a task.
    """
    most = texts.count() // SCAN_SHARE
    rare = materialise(rarest_runs(patterns, pattern, texts, text))
    probes = rare.filter(F.col("_texts").between(1, most)).select("_run", pattern)
    met = skew_safe_join(postings(texts, text), probes, "_run", F.col(text))
    found = met.filter(holds(F.col(text), F.col(pattern))).groupBy(pattern).agg(F.min(key).alias(key))
    return found, rare.filter(F.col("_texts").isNull() | (F.col("_texts") > most)).select(pattern)

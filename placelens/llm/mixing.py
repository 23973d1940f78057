"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.llm.common import materialise, md5_key, numbered, ranked, text_of, words_of

# A weight over training time: points (time from 0 to 1, weight), joined by straight lines.
Schedule = Sequence[tuple[float, float]]

# Their integrals are 5, 2 and 1: the first kind of source fades, the second is level, the third rises.
CURRICULUM: tuple[Schedule, ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def integral(schedule: Schedule) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False))


def time_of(schedule: Schedule, share: Column) -> Column:
    """The time by which a share (0 to 1) of the schedule's integral has passed."""
    y = share * integral(schedule)
    found, ahead = F.lit(1.0), 0.0
    parts = []
    for (a, v), (b, w) in zip(schedule, schedule[1:], strict=False):
        slope, rest = (w - v) / (b - a), F.greatest(y - ahead, F.lit(0.0))
        # The root of v x + slope x^2 / 2 = rest that stays finite for a level schedule.
        below = v + F.sqrt(F.greatest(F.lit(v * v) + 2 * slope * rest, F.lit(0.0)))
        inside = F.least(F.when(below > 0, 2 * rest / below).otherwise(F.lit(0.0)), F.lit(b - a))
        ahead += (b - a) * (v + w) / 2
        parts.append((ahead, a + inside))
    for end, when in reversed(parts):
        found = F.when(y < end, when).otherwise(found)
    return found


def water_fill(sources: DataFrame, most: int) -> float:
    """The level at which sum(least(weight * level, most * size)) is the sum of sizes.

    Each turn shares what the full sources leave among the others by weight; a
    turn sums over all sources, and only two numbers come back.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while total:
        full = most * F.col("source_size") < F.col("weight") * F.lit(level)
        held, weights = sources.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        new = (total - held) / weights if weights else level
        if new <= level:
            break
        level = new
    return level


def assign_positions(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    schedules: Sequence[Schedule] = CURRICULUM,
    most: int = 3,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, positions (and, with `carry`, `_row`).

    Sources in code point order (null last) take the schedules in turn. A
    source's weight is its schedule's integral; the weights share the words of
    all documents, but a target stops at `most` times its source, the excess
    going to the others by weight. A source's documents, in an order hashed from
    their ids, lie one behind the other on its axis of demanded words, pass
    after pass; the schedule's cumulative demand, inverted, gives the training
    position (0 to 1) at which each use begins. The last use is cut at the
    target: `taken` counts words, so a source's sum is its target but for the
    fraction of a word.

    A null or empty text has size 0 and takes nothing. Rows of one id are
    ordered by size, equal ones are interchangeable; a null id counts as an
    empty one. An empty table gives an empty one; other columns are not read.
    """
    text, source = text_of(F.col(text_column)), F.col(source_column).cast("string")
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.size(words_of(text)).cast("bigint").alias("size"),
        F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("_source"),
        md5_key(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("_key"),
        *([F.struct("*").alias("_row")] if carry else []),
    )
    rows = materialise(rows)
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    turn = F.pmod(F.col("_place"), F.lit(len(schedules))).cast("int")
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    sources = materialise(
        numbered(materialise(sizes), ["_source"], "_place").select(
            "_source", "source_size", "rows", turn.alias("_turn"), F.get(weights, turn).alias("weight")
        )
    )
    level, n = water_fill(sources, most), sources.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(most)))
    per_source = sources.select("_source", "source_size", "_turn", target.alias("target"))
    placed = ranked(rows, "_source", "_key", n, "size", ["doc_id", "size"], per_source)

    whole = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    rest = whole - passes * F.col("source_size")
    last = F.greatest(F.least(rest - F.col("_before"), F.col("size")), F.lit(0))
    uses = F.col("_passes") + F.when(F.col("_last") > 0, 1).otherwise(0)

    def position(use: Column) -> Column:
        share = (use * F.col("source_size") + F.col("_before")) / F.col("target")
        found = F.lit(None).cast("double")
        for i, schedule in enumerate(schedules):
            found = F.when(F.col("_turn") == i, time_of(schedule, share)).otherwise(found)
        return found

    numbers = F.when(uses > 0, F.sequence(F.lit(0).cast("bigint"), uses - 1)).otherwise(F.array().cast("array<bigint>"))
    return (
        placed.withColumn("_passes", passes.cast("bigint"))
        .withColumn("_last", last.cast("bigint"))
        .withColumn("taken", F.col("_passes") * F.col("size") + F.col("_last"))
        .withColumn("positions", F.transform(numbers, position))
        .withColumn("last_words", F.when(F.col("_last") > 0, F.col("_last")).otherwise(F.col("size")))
        .select(
            "doc_id", "size", "source_size", "target", "taken", "positions", "last_words", *(["_row"] if carry else [])
        )
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """The carried rows, one for each use, range-sorted by training position.

    A document is used as a whole: the use that the target cuts stays if half of
    the document or more lies before the cut.
    """
    kept = F.when(
        2 * F.col("last_words") >= F.col("size"), F.col("positions")
    ).otherwise(F.slice("positions", 1, F.size("positions") - 1))
    used = assigned.select("doc_id", "_row", F.explode(kept).alias("_position"))
    return used.orderBy("_position", "doc_id").select("_row.*")

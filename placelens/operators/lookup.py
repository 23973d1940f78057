"""Look places up by name."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.operators.blocks import BLOCK_QUERIES, score_blocks
from placelens.operators.phrases import PhraseFinder
from placelens.operators.skew import skew_safe_join
from placelens.operators.substrings import first_holding, lower_ascii
from placelens.session import materialise


def find_places(lookups: DataFrame, places: DataFrame, asked: str, name: str, key: str) -> DataFrame:
    """The first place (lowest key) per asked name, equal without regard to case, and a found flag."""
    named = lookups.withColumn("_name", F.lower(asked))
    first = places.groupBy(F.lower(name).alias("_name")).agg(F.min(key).alias(key))
    # Each asked name is resolved once, however often it is asked for.
    found = named.select("_name").distinct().join(first, "_name").join(places, key)
    full = skew_safe_join(named, found, "_name", F.monotonically_increasing_id(), "left").drop("_name")
    return full.withColumn("found", F.col(key).isNotNull())


def like_scorer(pattern: str, name: str):
    """1 where a name holds a pattern anywhere; % and _ in a pattern are wildcards, the case of A-Z does not count.

    A missing pattern is found nowhere.
    """

    def lower(text: str | None) -> str:
        return "\0" if text is None else text.encode().lower().decode()

    def prepare(queries: pa.Table):
        patterns = [lower(p) for p in queries.column(pattern).to_pylist()]
        plain = PhraseFinder([p if not _WILD.search(p) else "\0" for p in patterns])
        wild = {i: _regex(p) for i, p in enumerate(patterns) if _WILD.search(p)}

        def score(items: pa.Table) -> np.ndarray:
            names = [None if n is None else lower(n) for n in items.column(name).to_pylist()]
            found = plain.hits(names)
            for i, regex in wild.items():
                found[i] = [n is not None and regex.search(n) is not None for n in names]
            return np.where(found > 0, found, -np.inf)

        return score

    return prepare


_WILD = re.compile(r"[%_]")


def _regex(pattern: str) -> re.Pattern:
    signs = {"%": ".*", "_": "."}
    return re.compile("".join(signs.get(c, re.escape(c)) for c in pattern), re.DOTALL)


def find_places_like(
    lookups: DataFrame,
    places: DataFrame,
    asked: str,
    name: str,
    key: str,
    lookup_id: str,
    max_queries: int = BLOCK_QUERIES,
    **blocks,
) -> DataFrame:
    """The first place (lowest key) whose name holds the asked text: (lookup_id, key).

    Lookups that fit one block are searched in one scan of the names. More are
    resolved once per asked text, by the rarest run of three characters, which
    most names do not have; short texts and runs of many names are scanned for.
    A missing text or name, and one found nowhere, has no row.
    """

    def scan(queries: DataFrame, items: DataFrame, query_id: str, text: str, item_text: str) -> DataFrame:
        scorer, size = like_scorer(text, item_text), F.octet_length(text) + 16
        found = score_blocks(queries, items, scorer, 1, query_id, key, size, max_queries=max_queries, **blocks)
        return found.select(query_id, key)

    if lookups.limit(max_queries + 1).count() <= max_queries:
        return scan(lookups.select(lookup_id, asked), places.select(key, name), lookup_id, asked, name)
    asked_for = lookups.select(F.col(lookup_id), lower_ascii(F.col(asked)).alias("_pattern"))
    asked_for = asked_for.filter(F.col("_pattern").isNotNull())
    patterns = materialise(asked_for.select("_pattern").distinct())
    names = places.groupBy(lower_ascii(F.col(name)).alias("_name")).agg(F.min(key).alias(key))
    names = materialise(names.filter(F.col("_name").isNotNull()))
    found, left = first_holding(patterns, "_pattern", names, "_name", key)
    left = left.select("_pattern", F.col("_pattern").alias("_asked"))
    scanned = scan(left, names.select(key, "_name"), "_pattern", "_asked", "_name")
    resolved = skew_safe_join(
        asked_for, materialise(found.unionByName(scanned)), "_pattern", F.monotonically_increasing_id()
    )
    return resolved.groupBy(lookup_id).agg(F.min(key).alias(key))

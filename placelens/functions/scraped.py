"""Functions over fields as they come from a review page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions.text import contains_any, let, trim_all


def likely_owner(text: Column) -> Column:
    """True for answers by the owner: owner words without a visitor's pronoun, or a vowel-less stub."""
    stub = (F.length(text) < 5) & ~F.lower(text).rlike("[aeiou]")
    owner = let(
        F.lower(text),
        lambda t: contains_any(t, fixed.OWNER_WORDS) & ~contains_any(t, fixed.VISITOR_PRONOUNS),
    )
    return F.coalesce(stub | owner, F.lit(False))


def rating_label(label: Column) -> Column:
    """'4 bintang' or '4 stars' or '4/5' gives '4'; anything else '0'."""
    starred = F.contains(label, F.lit("stars")) | F.contains(label, F.lit("bintang"))
    return F.coalesce(
        F.when(starred, F.trim(F.split(label, " ")[0]))
        .when(F.contains(label, F.lit("/5")), F.trim(F.split(trim_all(label), "/")[0])),
        F.lit("0"),
    )


def time_label(label: Column) -> Column:
    """The label if it speaks of time, else ''."""
    return F.when(contains_any(label, fixed.TIME_WORDS), trim_all(label)).otherwise(F.lit(""))


def hours_label(label: Column) -> Column:
    """Opening hours with narrow blanks replaced; a default where there are none."""
    shown = F.when(F.length(label) > 0, trim_all(F.replace(label, F.lit("\u202f"), F.lit(" "))))
    return F.coalesce(shown, F.lit(fixed.CHECK_HOURS))


def repair_url(url: Column) -> Column:
    """Struct (url, error): the repaired link, or null and the reason."""
    raw = trim_all(url)
    error = F.when(F.contains(raw, F.lit("googleusercontent")), F.lit(fixed.IMAGE_LINK)).when(
        F.contains(raw, F.lit(" ")) & ~F.contains(raw, F.lit(".")), F.lit(fixed.NOT_A_LINK)
    )
    joined = (
        F.when(raw.startswith("httpsmaps"), F.replace(raw, F.lit("httpsmaps"), F.lit("https://maps")))
        .when(raw.startswith("httpmaps"), F.replace(raw, F.lit("httpmaps"), F.lit("http://maps")))
        .otherwise(raw)
    )
    absolute = F.when(joined.startswith("http"), joined).otherwise(F.concat(F.lit("https://"), joined))
    sign = F.when(F.contains(absolute, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    local = F.when(F.contains(absolute, F.lit("hl=")), absolute).otherwise(
        F.concat(absolute, sign, F.lit("hl=id"))
    )
    return F.struct(F.when(error.isNull(), local).alias("url"), error.alias("error"))

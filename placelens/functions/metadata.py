"""Price and facility functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placelens.functions import fixed_values as fixed
from placelens.functions.text import let, trim_all

PRICE_ITEMS = "array<struct<item:string,harga:double,kategori:string>>"


def price_items(text: Column) -> Column:
    """JSON price list as an array; null where the JSON is broken."""
    return F.from_json(text, PRICE_ITEMS)


def price_item_count(text: Column) -> Column:
    """Items of a JSON price list; 0 for none or broken JSON."""
    return F.when(price_items(text).isNull(), F.lit(0)).otherwise(F.size(price_items(text)))


def minimum_price(text: Column) -> Column:
    """Sum of the required items of a JSON price list.

    Null for no list, an empty list or broken JSON; 0 where no item is required.
    """
    required = lambda x: x["kategori"].isin(*fixed.REQUIRED_CATEGORIES)
    add = lambda total, x: total + F.coalesce(x["harga"], F.lit(0.0))
    total = lambda items: F.when(
        F.size(items) > 0, F.aggregate(F.filter(items, required), F.lit(0.0), add)
    )
    return let(price_items(text), total)


def facility_list(text: Column) -> Column:
    """Trimmed, non-blank parts of a pipe-separated text; null if there are none."""
    parts = F.filter(F.transform(F.split(text, r"\|"), trim_all), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p))


def facility_count(text: Column) -> Column:
    """Items of a JSON list, or pipe-separated parts with blanks counted; 0 where missing."""
    missing = text.isNull() | text.isin("", "nan")
    count = F.when(text.startswith("["), F.json_array_length(text)).otherwise(F.size(F.split(text, r"\|")))
    return F.when(missing, F.lit(0)).otherwise(F.coalesce(count, F.lit(0)))


def facility_output(text: Column) -> Column:
    """Facilities of a result as an array; [] where missing."""
    parts = F.transform(F.split(text, r"\|"), trim_all)
    parsed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == "nan"), none).otherwise(F.coalesce(parsed, parts))


def price_text(price: Column) -> Column:
    """Price with dots between thousands."""
    digits = F.translate(F.format_number(price.cast("bigint"), 0), ",", ".")
    return F.when(price.isNull() | (price == 0), F.lit(fixed.NO_PRICE)).otherwise(
        F.concat(F.lit("Rp "), digits)
    )


def facility_summary(facilities: Column, shown: int = 5) -> Column:
    """The first few facilities and '...' if there are more."""
    more = F.when(F.size(facilities) > shown, F.lit("...")).otherwise(F.lit(""))
    listed = F.concat(F.array_join(F.slice(facilities, 1, shown), " | "), more)
    return F.when(F.size(facilities) > 0, listed).otherwise(F.lit(fixed.NO_FACILITIES))


def photo_or_default(url: Column) -> Column:
    missing = url.isNull() | (url == "") | (F.lower(url) == "nan")
    return F.when(missing, F.lit(fixed.NO_PHOTO)).otherwise(url)

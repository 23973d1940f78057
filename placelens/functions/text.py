"""Text functions over string columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscore of every script; Java's \w alone is ASCII.
WORD = r"\p{L}\p{N}_"
# Every Unicode blank; Java's \s alone is ASCII.
BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_all(text: Column) -> Column:
    """Strip blanks of every kind, not only spaces."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def replace_where(sign: str, pattern: str, new: str) -> Callable[[Column], Column]:
    """Regex replacement that is skipped for texts without the sign every match holds."""
    return lambda text: F.when(
        F.contains(text, F.lit(sign)), F.regexp_replace(text, pattern, new)
    ).otherwise(text)


def clean_text(text: Column) -> Column:
    """Review text without links, mentions, tags, odd signs and repeated marks; '' for null."""
    guarded = [
        replace_where("http", rf"https?://[^{BLANK}]+", ""),
        replace_where("@", rf"@[{WORD}]+", ""),
        replace_where("#", rf"#[{WORD}]+", ""),
        # Blanks of every kind become spaces here too; runs of them are one space in the end.
        lambda c: F.regexp_replace(c, rf"[^a-zA-Z0-9 .,!?'\"\-{WORD}]", " "),
        replace_where("!!", r"!!+", "!"),
        replace_where("??", r"\?\?+", "?"),
        replace_where("..", r"\.\.+", "."),
    ]
    cleaned = reduce(let, guarded, F.coalesce(text, F.lit("")))
    return F.trim(let(F.lower(cleaned), replace_where("  ", "  +", " ")))


def clean_keywords(text: Column) -> Column:
    """Lower-case ASCII letters, digits and blanks only; everything else is deleted."""
    kept = F.regexp_extract_all(F.lower(text), F.lit(rf"([a-z0-9{BLANK}]+)"), 1)
    return F.array_join(kept, "")


def tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD}]{{2,}})"), 1)


def term_counts(text: Column) -> Column:
    """Distinct tokens of a text with their counts, as an array of (term, tf).

    Equal tokens lie together once sorted, so counts are distances between the
    starts of runs; all of it happens inside the row.
    """

    def counts(sorted_tokens: Column) -> Column:
        at_start = lambda token, i: F.when((i == 0) | (token != F.get(sorted_tokens, i - 1)), i)
        starts = F.array_compact(F.transform(sorted_tokens, at_start))
        ends = lambda s: F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(sorted_tokens)))
        run = lambda start, end: F.struct(
            F.get(sorted_tokens, start).alias("term"), (end - start).cast("bigint").alias("tf")
        )
        return let(starts, lambda s: F.when(F.size(s) > 0, F.zip_with(s, ends(s), run)))

    return let(F.sort_array(tokens(text)), counts)


def words(text: Column) -> Column:
    """Parts between blanks."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """True where the text holds at least one phrase as a substring."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False))


def flatten_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def title_name(name: Column) -> Column:
    """File-safe name in title case: a capital after every non-letter."""
    safe = trim_all(F.regexp_replace(name, r'[\\/*?:"<>|]', ""))
    runs = F.regexp_extract_all(safe, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    capital = lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2))))
    return F.array_join(F.transform(runs, capital), "")


# Days per unit of a time label.
UNIT_DAYS = {
    "detik|second|menit|minute|jam|hour": 0,
    "hari|day": 1,
    "minggu|week": 7,
    "bulan|month": 30,
    "tahun|year": 365,
}


def relative_date(label: Column, reference: Column) -> Column:
    """Estimated date of a label such as '2 minggu lalu' or 'a week ago'; null if it names no unit."""
    lowered = F.lower(label)
    number = F.nullif(F.regexp_extract(lowered, r"(\d+)", 1), F.lit("")).cast("int")
    days = F.coalesce(*[F.when(lowered.rlike(unit), F.lit(n)) for unit, n in UNIT_DAYS.items()])
    return F.date_sub(reference, F.coalesce(number, F.lit(1)) * days)

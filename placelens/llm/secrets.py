"""Secret scans over an incremental ledger of blobs: every text is stored under its hash and scanned once per rule version."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelens.llm.common import materialise, text_of


@dataclass(frozen=True)
class SecretRule:
    """Matches of `pattern`, leftmost and non-overlapping, whose group `group` has `least` characters or more.

    With `inside`, characters as in a bracket, a match does not begin behind one of them.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    inside: str = ""

    @property
    def bounded(self) -> str:
        return f"(?<![{self.inside}]){self.pattern}" if self.inside else self.pattern


# The base kinds in their listed order.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 18),
    SecretRule("hex", r"[0-9a-f]{16,}", 16),
)
# A private key from its BEGIN line to the END line, with no other such line between them; without an END line, over
# header lines and runs of 16 or more base64 characters that follow, and one shorter run after them. Java's matcher
# goes some calls deeper with every turn of a group, so these are bounded; after so many runs all base64 lines go.
_BASE64, _OTHER, _DEPTH = "[A-Za-z0-9+/=]", "[^A-Za-z0-9+/=-]", 200
_GAP = rf"{_OTHER}{{1,4}}[ \t]*"
_TO_END = rf"[^-]*(?:-{{1,4}}[^-]+){{0,{_DEPTH}}}-{{5,}}END [A-Z ]*PRIVATE KEY-----"
_RUN = rf"{_BASE64 * 16}{_BASE64}*"
_MORE = rf"(?:{_GAP}{_RUN})"
_BODY = (
    rf"(?:[ \t]*\r?\n[A-Za-z][A-Za-z-]*:[^\r\n]*){{0,8}}(?:{_GAP})?{_RUN}"
    rf"(?:{_MORE}{{{_DEPTH}}}[A-Za-z0-9+/=\r\n]*|{_MORE}{{0,{_DEPTH}}}(?:(?:\r?\n|\\\\)[ \t]*{_BASE64}+)?)"
)
_PRIVATE = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_BODY})?"

# Kinds that this scanner adds.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    SecretRule("google", r"AIza[A-Za-z0-9_-]+", 39),
    # Each run is read once: a match begins at a run's start, and no part of a run is given back.
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 32, inside="A-Za-z0-9_-"),
    SecretRule("private", _PRIVATE, 27),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:bigint,rule:int,kind:string,end:bigint>>"


def rules_version(rules: tuple[SecretRule, ...]) -> str:
    """Changes with any rule, so a changed rule set scans every blob anew."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hits(text: Column, number: int, rule: SecretRule) -> Column:
    """Per match: the characters since the end of the previous match, its length, and whether it is long enough.

    Empty if there is none, which one search finds out for nearly all texts.
    """
    pattern = F.lit(rule.bounded)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, rule.bounded)

    def hit(match: Column, gap: Column) -> Column:
        value = F.regexp_extract(match, rule.pattern, rule.group) if rule.group else match
        return F.struct(
            F.lit(number).alias("rule"),
            F.length(gap).cast("bigint").alias("gap"),
            F.length(match).cast("bigint").alias("length"),
            (F.length(value) >= rule.least).alias("valid"),
        )

    hits = F.zip_with(found, F.slice(between, 1, F.size(found)), hit)
    none = F.array().cast("array<struct<rule:int,gap:bigint,length:bigint,valid:boolean>>")
    return F.when(text.rlike(rule.bounded), hits).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, text) to (blob, hits), the matches of all rules; the text stops here.

    Every pattern reads a text in linear time. A null or empty text has no hits.
    """
    hits = F.concat(*[_hits(F.col("text"), i, rule) for i, rule in enumerate(rules)])
    return blobs.select("blob", hits.alias("hits"))


def place_hits(scanned: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, hits) to (blob, spans) for blobs with a valid match: spans by start, then rule.

    Places are running sums over a text's matches, in a window per blob and
    rule; only blobs with a match enter it. `blob` is unique.
    """
    hits = scanned.filter(F.size("hits") > 0).select("blob", F.posexplode("hits").alias("i", "hit"))
    so_far = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    placed = (
        hits.select("blob", "i", "hit.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far))
        .filter("valid")
        .withColumn("start", F.col("end") - F.col("length"))
        .withColumn("kind", F.get(kinds, F.col("rule")))
    )
    spans = F.sort_array(F.collect_list(F.struct("start", "rule", "kind", "end")))
    return placed.groupBy("blob").agg(spans.alias("spans"))


class Ledger:
    """Which blobs were scanned under which rule version, and what was found.

    A folder of Parquet tables, one per run; a run's table appears as a whole or
    not at all, so a failed run is simply done again. Two runs at a time may
    scan a blob twice, with equal results.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, version: str) -> DataFrame:
        """(blob, spans) of this rule version; blobs without findings have none."""
        schema = f"blob binary, version string, spans {SPANS}"
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/run=*")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], schema)
        return rows.filter(F.col("version") == version).select("blob", "spans")

    def append(self, scanned: DataFrame, version: str) -> None:
        rows = scanned.select("blob", F.lit(version).alias("version"), F.col("spans").cast(SPANS))
        rows.write.parquet(f"{self.folder}/run={uuid.uuid4().hex}")

    def is_new(self) -> bool:
        try:
            return self.spark.read.parquet(f"{self.folder}/run=*").isEmpty()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return True


def update_ledger(
    versions: DataFrame, text_column: str, ledger: Ledger, rules: tuple[SecretRule, ...] = RULES
) -> None:
    """Scan the blobs of `versions` that the ledger lacks for these rules, and record all of them.

    Copies of a blob collapse before the shuffle, so a text that a third of the
    rows share is moved once per task and scanned once.
    """
    version = rules_version(rules)
    text = text_of(F.col(text_column))
    texts = versions.select(text.alias("text")).withColumn("blob", blob_id(F.col("text")))
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if not ledger.is_new():
        blobs = blobs.join(ledger.read(version).select("blob"), "blob", "left_anti")
    scanned = materialise(scan_blobs(blobs, rules))
    # A blob without findings is recorded too, so it is not scanned again.
    ledger.append(scanned.select("blob").join(place_hits(scanned, rules), "blob", "left"), version)


def find_secrets(
    versions: DataFrame,
    keys: list[str],
    text_column: str,
    ledger: Ledger,
    rules: tuple[SecretRule, ...] = RULES,
) -> DataFrame:
    """One row per version of a path: its keys, the blob it holds, and the spans found there.

    Scans what the ledger lacks, then joins findings back to all paths; only
    blobs with findings enter that join, whose rows are keys and hashes. Spans
    are in code points, end exclusive, by start and then rule.

    A null text counts as empty and has no spans. Repeated rows give repeated
    results, an empty table an empty one, null keys stay null; other columns are
    not read.
    """
    update_ledger(versions, text_column, ledger, rules)
    paths = versions.select(*keys, blob_id(text_of(F.col(text_column))).alias("_blob"))
    found = ledger.read(rules_version(rules)).filter(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.first("spans").alias("spans")).select(F.col("blob").alias("_blob"), "spans")
    # Stored, so that the join shuffles both sides itself and may split a blob that very many paths hold.
    found = materialise(found)
    joined = paths.join(found, "_blob", "left")
    return joined.select(*keys, F.col("_blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def count_of(spans: Column, rule: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rule"] == rule)).cast("bigint")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of touching spans replaced by a mark; spans are sorted by start."""

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        new = F.struct(span["end"].alias("at"), F.concat(state["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out"))
        return F.when((span["start"] >= state["at"]) & ((span["start"] > state["at"]) | (state["at"] == 0)), new).otherwise(longer)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    end = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)

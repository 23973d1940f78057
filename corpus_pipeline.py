"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage but the last returns the columns it was given. The last returns one
row per piece of a document, with its place in a sequence.

A stage's result is written before the next stage begins, so the tables that it
stored on the way are removed then; those of the last stage stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import mixing, near_dups, packing, quality, secrets, tokens
from placelens.llm.common import materialise, read_table, text_of
from placelens.llm.queries import fit_quality
from placelens.session import noted_folders, remove_folders, run_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Per thread the folders of the stage before.
_FOLDERS: dict[int, list[str]] = {}


def stage(first: bool = False) -> Callable[[Stage], Stage]:
    """A stage of the pipeline, which removes the tables of the stage before, unless it is the first."""

    def wrap(function: Stage) -> Stage:
        @wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before, own = _FOLDERS.pop(get_ident(), []), []
            if not first:
                remove_folders(spark, before)
            _FOLDERS[get_ident()] = own
            with noted_folders(own):
                return function(spark, docs, sf_dir)

        return run_stage

    return wrap


@stage(first=True)
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or the log-likelihood ratio go.

    A null or empty text fails; a document at the threshold stays; repeated rows are judged alike and stay repeated.
    """
    judged = quality.judge_quality(docs, "doc_id", "text", fit_quality(spark, docs, sf_dir), carry=True)
    return quality.keep_rows(judged)


@stage()
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: of each group of linked documents (five words, 0.8) the one with the least id stays.

    That is one id and one text, also where ids are missing or come again. A document given twice (same id, same
    text) stays once.
    """
    kept = materialise(near_dups.kept_documents(docs, "doc_id", "text", words=5, percent=80))
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_id").alias("_text_id"))
    text_id = near_dups.text_id(text_of(F.col("text")))
    rows = docs.select(F.col("doc_id").alias("_id"), text_id.alias("_text_id"), F.struct("*").alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("_kept_id")) & (rows["_text_id"] == kept["_text_id"])
    rows = rows.join(kept, same, "left_semi")
    return rows.groupBy("_id", "_text_id").agg(F.first("_row").alias("_row")).select("_row.*")


@stage()
def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every document stays, each run of found characters becomes a mark; n_chars follows.

    The cleaned table goes through the ledger as the next version, of which only
    changed texts are unseen; what is found in those is blanked again, until nothing is.
    A null text stays null; repeated rows and equal texts are treated alike.
    """
    ledger = secrets.Ledger(spark, f"{run_folder(spark)}/ledger")
    version = secrets.rules_version(secrets.RULES)
    while True:
        secrets.update_ledger(docs, "text", ledger)
        found = ledger.read(version).filter(F.size("spans") > 0)
        found = materialise(found.groupBy("blob").agg(F.first("spans").alias("spans")))
        blob = secrets.blob_id(secrets.text_of(F.col("text")))
        rows = docs.select(blob.alias("blob"), F.struct("*").alias("_row"))
        if rows.join(found, "blob", "left_semi").isEmpty():
            return docs
        docs = materialise(_blanked(rows.join(found, "blob", "left"), docs.dtypes))


def _blanked(joined: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """The rows of `joined` with their spans blanked."""
    text, spans = F.col("_row.text"), F.col("spans")
    joined = joined.withColumn("_clean", F.when(spans.isNull(), text).otherwise(secrets.redacted(text, spans)))

    def column(name: str, kind: str) -> Column:
        if name == "text":
            return F.col("_clean").alias(name)
        if name == "n_chars":
            return F.when(spans.isNotNull(), F.length("_clean")).otherwise(F.col("_row")[name]).cast(kind).alias(name)
        return F.col("_row")[name].alias(name)

    return joined.select(*[column(name, kind) for name, kind in kinds])


@stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents as often as their source's target takes them, in the order of training.

    A null source is a source; texts without words are never taken; repeated rows are documents of their own; of
    equal positions the smaller id comes first.
    """
    return mixing.training_order(mixing.assign_positions(docs, "doc_id", "text", "source", carry=True))


@stage()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of at most 1024 tokens.

    A null or empty text is the end token alone; repeated rows and ids give pieces of their own; which of
    equally long pieces takes which place is left open.
    """
    return packing.pack_documents(docs, "doc_id", "text", tokens.tokenizer_path(tokens.BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", blank_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = materialise(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Tokenizing and hashing with xxHash have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

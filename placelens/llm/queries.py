"""Registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import (
    chat,
    fingerprints,
    importance,
    languages,
    merkle,
    mixing,
    near_dups,
    packing,
    quality,
    secrets,
    sharding,
    tokens,
    urls,
)
from placelens.llm.common import read_table
from placelens.session import run_folder

URL_RULES = (
    urls.parse_rule("allow", "org/"),
    urls.parse_rule("block", "example.org/es/"),
    urls.parse_rule("block", "example.org/en/1"),
    urls.parse_rule("allow", "com/fr/"),
    urls.parse_rule("block", "com/de/"),
)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, folder, "pages"), "page_id", "url", URL_RULES)


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    mixed = mixing.assign_positions(docs, "doc_id", "text", "source", mixing.CURRICULUM, 3)
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.size("positions").alias("n_uses"),
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position"),
    ).orderBy("first_position", "doc_id")


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, "doc_id", "text", tokens.tokenizer_path(tokens.BYTE_BPE), 1024, 2)


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    # A document without an id is not held out.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = languages.fit_languages(docs, "doc_id", "text", "lang", ~held_out)
    return languages.identify_languages(docs, "doc_id", "text", model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The table is recorded, then comes again as its next version, of which every blob is known by then."""
    ledger = secrets.Ledger(spark, f"{run_folder(spark)}/ledger")
    docs = read_table(spark, folder, "documents")
    secrets.update_ledger(docs, "text", ledger)
    found = secrets.find_secrets(docs, ["doc_id"], "text", ledger)
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE_RULES))
    counts = [secrets.count_of(F.col("spans"), i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return near_dups.near_duplicates(docs, "doc_id", "text", words=3, percent=85)


def op7_uniform_shards(spark: SparkSession, folder: str) -> DataFrame:
    shuffled = sharding.shuffle_to_shards(read_table(spark, folder, "documents"), "doc_id", "text", 16)
    return shuffled.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    found = fingerprints.fingerprint_edits(read_table(spark, folder, "documents"), "doc_id", "text")
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        fingerprints.distinct_count(F.col("sketch")).alias("n_shingles"),
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return tokens.count_tokens(docs, "doc_id", "text", tokens.tokenizer_path(tokens.BYTE_BPE), 1024)


def fit_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Trusted are the documents that the labels call good."""
    trusted = quality.trusted_ids(read_table(spark, folder, "labels"), "doc_id", F.col("quality") == 1)
    return quality.fit_ratio(docs, "doc_id", "text", trusted)


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.judge_quality(docs, "doc_id", "text", fit_quality(spark, docs, folder))


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    bare = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = merkle.leaf_digest(*[F.col(c) for c in LEAF_COLUMNS[:-1]], bare)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    manifest = merkle.build_manifest(docs, "doc_id", "source", LEAF_COLUMNS, carry=F.when(chosen, tampered))
    folded = merkle.folded(F.coalesce("carry", "leaf"), F.col("path"))
    found = merkle.proofs(manifest).withColumn("folded_root", folded)
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    target = importance.bucket_counts(read_table(spark, folder, "benchmark"), "text")
    gains = importance.bucket_gains(importance.bucket_counts(docs, "text"), target)
    drawn = importance.draw_documents(importance.score_documents(docs, "doc_id", "text", gains))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = [(-7, i, role, said) for i, role in enumerate(("user", "assistant"))]
    chats = given.unionByName(spark.createDataFrame(more, given.schema))
    read = chat.read_back(chat.format_turns(chats, "conv_id", "turn", "role", "text"))
    order = chat.check_order(chats, "conv_id", "turn", "role").drop("n_turns")
    same = read["conv_id"].eqNullSafe(order["conv_id"])
    return read.join(order, same).select(
        read["conv_id"],
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
        (F.col("n_bad") == 0).alias("in_order"),
        "end_state",
    )


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_source_mix,
        op3_best_fit_packing,
        op4_language_id,
        op5_secret_scan,
        op6_near_duplicates,
        op7_uniform_shards,
        op8_fingerprints,
        op9_token_counts,
        op10_quality_rules,
        op11_merkle_manifest,
        op12_target_resampling,
        op13_chat_format,
    )
}

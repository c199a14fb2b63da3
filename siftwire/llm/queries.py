"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm import bpe, chat_format, embed_dedup, exact_search, hard_negatives, html_extract, license_scan, mixing, ngram_join, oracles, prefix_trie, quality, secret_scan, toxicity
from siftwire.llm.sized import sized
from siftwire.session import stored


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.forest_sql(secret_scan.labelled_findings(spark))
    scanned = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), forest)
    best = F.array_max(F.transform(F.concat("secrets", "rejected"), lambda f: f["score"]))
    return scanned.select(
        "doc_id",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.size("rejected").cast("long").alias("n_rejected"),
        F.array_join(F.transform("secrets", lambda f: F.concat_ws("-", f["start"].cast("string"), (f["start"] + f["length"]).cast("string"))), ",").alias("spans"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return quality.assess(docs, docs.join(sized(trusted), "doc_id", "left_semi")).drop("text")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Weights of the mix over domain, language and source; nodes that aren't named weigh 1 among their siblings.
MIX = {
    ("d0",): 0.5,
    ("d1",): 0.3,
    ("d2",): 0.2,
    **{(d, lang): w for d in ("d0", "d1", "d2") for lang, w in (("en", 0.6), ("de", 0.15), ("fr", 0.15), ("es", 0.1))},
}


def with_domain(docs: DataFrame) -> DataFrame:
    """The table has no domains; sources are dealt to three by their name."""
    return docs.withColumn("domain", F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(3)).cast("string")))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    mixed = mixing.mix(docs, ["domain", "lang", "source"], MIX, 1.0, max_epochs=2.0, seed=1)
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    calls, results = chat_format.exchanges(turns)
    linked = chat_format.link(calls, results, chat_format.schema_rows(spark, chat_format.REPLY_SCHEMA))
    return linked.select("conv_id", "turn", "call_id", "place", "status", F.array_join("errors", ";").alias("errors"), F.sha2("json", 256).alias("json_sha256"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages, html_extract.fit(spark)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors.withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.encoded(_read(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    sequences = stored(prefix_trie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4), "rebuilt")
    return prefix_trie.trie(sequences, turns.select("conv_id").distinct())


def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_secret_scan": op2_secret_scan,
        "op3_chat_format": op3_chat_format,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_scan": op5_license_scan,
        "op6_source_mixing": op6_source_mixing,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_ngram_join": op9_ngram_join,
        "op10_html_extract": op10_html_extract,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_exact_search": op13_exact_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_license_scan": oracles.op5(),
        "op7_embedding_dedup": oracles.OP7,
        "op9_ngram_join": oracles.OP9,
        "op11_hard_negatives": oracles.OP11,
        "op12_prefix_trie": oracles.OP12,
        "op13_exact_search": oracles.OP13,
    }

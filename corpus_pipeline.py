"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``. Every stage works on all rows
that its predecessor kept:

1.  toxicity: documents that the classifier rejects go. It learns from the labels in ``sf_dir``, but from none
    that is held out.
2.  near_duplicates: of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document
    with the smallest id stays, repeated rows become one. Rows without an id stay; an id that stands for
    its own group stays with all its texts.
3.  secrets: found secrets are replaced in the text, n_chars follows.
4.  source_mix: documents are selected to the target weights of domain, language and source.
5.  tokens: every document as byte-level BPE ids, packed as little-endian 32-bit integers.

Null texts are never toxic, near copies or secrets; they take no budget and have no ids. Empty input gives
empty output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwire.llm import bpe, mixing, ngram_join, queries, secret_scan, toxicity
from siftwire.llm.sized import sized
from siftwire.session import short_plan_texts, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def frugal(stage: Stage) -> Stage:
    """A stage whose many jobs leave little in the driver's memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with short_plan_texts(spark):
            return stage(spark, docs, sf_dir)

    return run


#: The share of all tokens that the mix may take; no document is repeated.
BUDGET = 0.9


@frugal
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.where(~toxicity.held_out("doc_id")), labels.where(~toxicity.held_out("doc_id")))
    judged = toxicity.score(docs, model, output="__score")
    return judged.where("__score < 0.5").select(docs.columns)


@frugal
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(docs).where("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ids = stored(ids.where("not stays or n > 1"), "near")
    kept = docs.join(sized(ids.where("not stays").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    repeated = sized(ids.where("stays").select("doc_id"))
    if not ids.where("stays").limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


@frugal
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = secret_scan.forest_sql(secret_scan.labelled_findings(spark))
    clean = secret_scan.redact(secret_scan.scan(docs, forest))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@frugal
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(queries.with_domain(docs), ["domain", "lang", "source"], queries.MIX, BUDGET, max_epochs=1.0, seed=1)
    return mixed.select(docs.columns)


@frugal
def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    # Less memory for words than the operator takes by itself: what the stages before have left in the executors counts too.
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, packed=True, remembered=24 << 20)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
    ("tokens", to_tokens),
]

#: Trained models, hashes and token ids are beyond SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

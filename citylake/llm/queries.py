"""The registered queries of this subpackage. None has check SQL: see tests/llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citylake.llm import class_lm, embedding_dedup, language, quality, secrets
from citylake.llm.automaton import round_trip
from citylake.llm.codes import read_codes, write_codes
from citylake.llm.common import documents, ship
from citylake.llm.packing import pack
from citylake.llm.periodic_runs import longest, periodic_runs, planted
from citylake.llm.simhash import near_duplicates
from citylake.llm.spelling import misspelled_words, variants
from citylake.llm.suffix_dedup import remove_repeats
from citylake.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")


@register
def op6_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_codes(write_codes(documents(spark, sf_dir))).drop("ids")


@register
def op10_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256")
    )


@register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = secrets.findings(docs, secrets.scan(docs))

    def of(*kinds: str):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    base = of(*[r.kind for r in secrets.BASE])
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    rows = rows.select("doc_id", *counts, base.alias("base"), "spans")
    return rows.select(
        "doc_id", *[f"n_{r.kind}" for r in secrets.BASE], F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


@register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.profiles(docs.where(~language.held_out()))
    rows = language.predict(docs.select("doc_id", "text"), learned)
    return rows.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judge(docs, quality.ratio(quality.trusted(docs, labels), docs))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@register
def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


@register
def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.perplexities(documents(spark, sf_dir))


@register
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), limit=512)


@register
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(misspelled_words(documents(spark, sf_dir)))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(planted(documents(spark, sf_dir))).withColumn("best", longest())
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

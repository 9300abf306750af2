"""A text-cleaning pipeline: stages that each work on all documents that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylake.llm import language, secrets, suffix_dedup
from citylake.llm.common import as_row, ship, stored
from citylake.llm.packing import pack
from citylake.llm.shingles import components_of, text_key


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set each document's language to the predicted one; documents in no language (null texts, texts without
    a letter, or texts that share nothing with any profile) go. Profiles are learned from all documents with a
    language."""
    ship(spark)
    found = language.predict(_carried(docs), language.profiles(docs))
    found = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0))
    return found.select(*_back(docs, lang=F.col("lang_pred")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies, texts whose shingles of five words have a Jaccard
    similarity of 0.8 or more: that with the smallest id. Documents with a null id stay, since nothing tells
    them apart; of rows with the smallest id of a group just one stays, that whose hash is the smallest. Groups
    are of texts, so two different texts under one id are judged each on its own."""
    ship(spark)
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), own.alias("_own"), text_key().alias("key"))
    rows = rows.join(components_of(docs), F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "key"))
    first = rows.groupBy("group").agg(F.min(F.struct("_id", "_own")).alias("first")).select("first.*").distinct()
    # the same plan at every size: most documents stay, so their ids soon outgrow a broadcast
    kept = docs.hint("merge").join(first, (F.col("doc_id") == F.col("_id")) & (own == F.col("_own")), "left_semi")
    kept = kept.withColumn("_own", own).dropDuplicates(["doc_id", "_own"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut from each text the bytes of every repeated string of 200 bytes; what is left of a character that
    was cut in two goes as well. Every document stays, also one with nothing left."""
    ship(spark)
    rows = suffix_dedup.remove_repeats(_carried(docs))
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    mended = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\\ufffd", "")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.coalesce(whole, mended))
    return _measured(rows.withColumn("text", text), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark. Every document stays."""
    found = secrets.findings(_carried(docs), secrets.scan(docs))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(secrets.redacted())
    return _measured(found.withColumn("text", text), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see ``packing.pack``."""
    ship(spark)
    return pack(docs)


def _carried(docs: DataFrame) -> DataFrame:
    """What an operator needs of the documents, and all their columns in a struct, out of reach of its names."""
    return docs.select(as_row(docs), "doc_id", "text")


def _back(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of that struct, but for the new ones."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def _measured(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*_back(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))


STAGES = [
    ("language", by_language),
    ("near_duplicates", one_of_each_group),
    ("repeated_strings", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None  # hashes of shingles, tokens and packing have no SQL form; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

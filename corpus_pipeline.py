"""The corpus pipeline over ``documents``.

Quality filter, near-duplicate removal, redaction of personal data, source mixing, SentencePiece
encoding. Each stage takes (spark, docs, sf_dir), where docs is the stored result of the stage before,
and all but the last return the columns of documents (further columns of docs are left out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, pii, quality, sentencepiece_viterbi
from millrace.llm.common import bounded_batches, hint_small, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """docs less the rows whose ``key`` is in ``gone``; the keys are broadcast only if counted small."""
    gone = materialize(gone.distinct(), name)
    return docs.join(hint_small(gone, gone.count()), key, "left_anti").select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted model is within their language's threshold."""
    bounded_batches(spark)
    row = [F.col(c) for c in ("doc_id", "text", "lang")]
    key = F.concat(F.hex(F.xxhash64(*row)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *row)))  # equal rows have equal scores
    keyed = docs.select(*COLUMNS).withColumn("_key", key)
    scored = quality.classify(keyed, table(spark, sf_dir, "labels"), ["_key"])
    return _without(keyed, scored.where("not keep").select("_key"), "_key", "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest id stays.

    Rows that repeat an id are documents of their own: of those with equal texts one stays, those with different texts stay
    unless their group holds a smaller id. Documents without an id or without words stay.
    """
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    groups = materialize(jaccard.similar_components(docs, shingle=5, num=80, den=100), "groups")
    kept = _without(docs, groups.where("component_id < doc_id").select("doc_id"), "doc_id", "duplicates")
    again = materialize(groups.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    n = again.count()
    if not n:
        return kept
    again = hint_small(again, n)
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(*[F.first(c).alias(c) for c in COLUMNS[2:]])
    return kept.join(again, "doc_id", "left_anti").unionByName(once.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span replaced by its kind; null texts stay null."""
    bounded_batches(spark)
    found = pii.detect(docs.withColumn("_null", F.col("text").isNull()), ["doc_id", "lang", "source", "_null"])
    text = F.when(~F.col("_null"), F.col("redacted"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(F.when(~F.col("_null"), F.col("redacted"))).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson draws towards square-root source weights, in global random order."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every copy, and the digest of what they decode to."""
    bounded_batches(spark)
    coded = sentencepiece_viterbi.encode_column(docs, ["doc_id", "lang", "source"], decoded=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

ORACLE_SQL = None  # an LSTM, a language model and a Viterbi search are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

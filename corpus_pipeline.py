"""A training-data pipeline over `documents`: quality, exact and near copies, benchmark leaks, token ids.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents, whatever further ones there are. A
stage deletes the intermediate folders of the one before, whose result must be written by then.

In every stage a null text counts as empty, texts may have any length, rows may repeat, and no rows give no rows.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, quality, sentencepiece_bpe, simhash, streaming_dedup
from orrery.llm.common import cut, table
from orrery.storage import made, release

_SCRATCH: list[str] = []


def stage(f):
    """f, which first deletes the folders that the stage before made."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _SCRATCH)
        before = set(made())
        out = f(spark, docs, sf_dir)
        _SCRATCH[:] = [x for x in made() if x not in before]
        return out

    return run_stage


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, rows with a null doc_id too; labels that are null or missing don't count."""
    own = docs.select("doc_id", "text", "source", "lang", F.struct("*").alias("document"))
    judged = quality.judge(own, table(spark, sf_dir, "labels"), with_text=False)
    return judged.filter("keep").select("document.*")


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest doc_id, null ids last."""
    return streaming_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingle similarity of 0.8 or more: that with the smallest doc_id. Texts
    without words and rows with a null doc_id link to none and stay."""
    return simhash.drop_near_copies(docs, k=5, similarity=0.8)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; a null doc_id is judged like any other."""
    leaks = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    leaks = cut(leaks.select("doc_id").distinct(), "leaks")
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = rows.join(leaks.filter("doc_id is not null"), "doc_id", "left_anti").select(*docs.columns)
    if leaks.filter("doc_id is null").isEmpty():
        return named
    # Rows without an id are told apart by their texts.
    texts = rows.filter("doc_id is null").select("text").distinct().withColumn("doc_id", F.xxhash64("text", F.lit(1)))
    bad = decontaminate.contamination(texts, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").join(texts, "doc_id").select("text")
    return named.filter("doc_id is not null").unionByName(named.filter("doc_id is null").join(cut(bad, "leaks"), "text", "left_anti").select(*docs.columns))


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of the documents that are left."""
    out = sentencepiece_bpe.encode_decode(docs, sentencepiece_bpe.model_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("sentencepiece", token_ids),
]

ORACLE_SQL = None  # fitted classifier and tokenizer; the tests hold it against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, f) in enumerate(STAGES):
        docs = cut(f(spark, docs, sf_dir), f"pipeline-{i}")
    return docs

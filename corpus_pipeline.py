"""A corpus made ready for training, in five stages; each reads the table that the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselune.llm.common import Scratch, stored, table
from tesselune.llm.decontam import contaminated
from tesselune.llm.mixing import mix, mixed_documents, unused
from tesselune.llm.neardup import near_duplicates
from tesselune.llm.quality import fit_quality, score_quality
from tesselune.llm.tokenfiles import token_digest
from tesselune.storage import workspace

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Broadcasts of the near-duplicate stage keep to so many bytes: the driver still has what the other stages grew it to.
NEAR_BROADCAST = 4 << 20


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, and the column that tells them apart: doc_id, or, if ids are null or repeat, a number written with each row.

    The number's column has a name that no column of docs has.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").limit(1).count():
        key = unused("_row", docs.columns)
        return stored(docs.withColumn(key, F.monotonically_increasing_id())), key
    return docs, "doc_id"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; those it was not taught on are scored alike."""
    scores = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), carry=True)
    return scores.where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates, one row of it; a null id comes last."""
    rows, key = told_apart(docs)
    t = Scratch(spark, NEAR_BROADCAST)
    found = near_duplicates(rows, id_col=key, scratch=t)
    if key != "doc_id":
        found = found.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key))
        found = found.groupBy("component_id").agg(least.alias("least")).select(F.col(f"least.{key}").alias("doc_id"), F.lit(True).alias("kept"))
    kept = stored(found.where("kept").select(F.col("doc_id").alias(key)))
    t.drop_all_but()
    return rows.join(kept, key, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item; each row goes by its own text."""
    rows, key = told_apart(docs)
    leaks = stored(contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct())
    return rows.join(leaks, key, "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, dealt to shards by the splitting tree and shuffled in each.

    The share is that of one epoch and a half, as the operator's default; a source whose target lies below
    its size gives fewer documents and others give some twice. Rows of a null or repeated id are documents of
    their own; draws then follow the rows' numbers. Rows are written in order of shard and shuffled place: the
    one shuffle of texts here, and the next stage keeps to that order.
    """
    rows, key = told_apart(docs)
    _, blocks = mix(rows, id_col=key, block_words=0)
    return mixed_documents(rows, blocks, id_col=key).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the mix's order, that of the files of docs, read back: (doc_id, start, n_tokens, ids_crc32).

    Rows that are not read from files have no such order and go by their ids.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return token_digest(docs, TOKENIZER)
    return token_digest(docs, TOKENIZER, as_they_lie=True)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("token files", tokens),
]

#: Learned scores, chosen-path joins and tilings are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and reread as the next one's docs.

    A stage's own tables go when its result is written, and that when the next stage has read it.
    """
    docs, t = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with workspace(spark):
            made = t.put(stage(spark, docs, sf_dir))
        t.drop(docs)
        docs = made
    out = STAGES[-1][1](spark, docs, sf_dir)  # has read its input when it returns: it reads its own files back
    t.drop(docs)
    return out

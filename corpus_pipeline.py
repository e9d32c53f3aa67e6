"""From documents to training shards: five operators in turn, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch
from folioscope.llm.decontaminate import decontaminate
from folioscope.llm.mixing import mix_sources
from folioscope.llm.neardup import keep_one
from folioscope.llm.sharding import shard_documents
from folioscope.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half. Null and empty texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return score_toxicity(docs.select(columns, "doc_id", "text"), labels).where("predicted = 0").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; those without words stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't exceed the coverage limit, which is none of their words here: one window of a benchmark item rejects a document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return decontaminate(docs.select(columns, "text"), benchmark, most_share=0.0).where("not rejected").select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to whole documents: a copy that the budget cuts counts if half
    of it is taken. Repeated rows are taken together. Documents without words aren't taken. The columns travel as one, so that none can clash."""
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(columns.alias("doc"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    mixed = mix_sources(keyed.select("row", "doc_id", "text", "source"))
    times = mixed.where("taken > 0").groupBy("row", "doc_id").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    times = Scratch(spark, "mixed").save(times.select(F.col("row").alias("of"), F.col("doc_id").alias("id"), "times"))
    taken = keyed.join(times, (F.col("row") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["row", "doc_id"])
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return shard_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Neither the trained score nor the components of the similarity join are SQL: the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, as on a cluster."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), STAGES[-1][0]
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs if name == last else scratch.save(docs)
    return docs

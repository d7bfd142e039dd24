"""The corpus pipeline: toxicity filter, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``. Each row is
judged on its own text, also where its id is null or comes again with another text; of rows equal in
id and text the deduplication stages keep one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm.exact_dedup import exact_dedup
from mnemolith.llm.mixing import sample_mix
from mnemolith.llm.ngram_join import ngram_join
from mnemolith.llm.packing import pack_buckets
from mnemolith.llm.toxicity import drop_toxic, fit_toxicity
from mnemolith.sources.tables import Scratch, broadcast_if_small, materialize, shared_dir


def rows_by_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """One row for each id and text, and the name of a column that tells them apart: the id where all
    are unique, else a number in the order of ids, null ones last, and of hashes of the text."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    key, own = "_row_key", [F.col("doc_id").alias("_id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("_hash")]
    names = materialize(docs.select(*own).groupBy("_id", "_hash").agg(F.count("*").alias("_times")))
    names = materialize(names.orderBy(F.col("_id").asc_nulls_last(), "_hash").withColumn(key, F.monotonically_increasing_id()))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), own[1], docs["doc_id"].alias("_own"))
    rows = rows.join(broadcast_if_small(names), F.col("_own").eqNullSafe(F.col("_id")) & (rows["_hash"] == names["_hash"])).select("_doc", key, "_times")
    more = rows.where("_times > 1").groupBy(key).agg(F.min("_doc").alias("_doc"))
    rows = rows.where("_times = 1").select("_doc", key).unionByName(more.select("_doc", key))
    return materialize(rows.select("_doc.*", key)), key


def without(docs: DataFrame, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs but for the rows whose key is in ``doc_id`` of what ``dropped`` returns for (rows, key);
    texts are shuffled only if those are many or ids aren't unique."""
    rows, key = rows_by_key(docs)
    gone = materialize(dropped(rows, key).select(F.col("doc_id").alias("_dropped")).distinct())
    gone = broadcast_if_small(gone)
    return rows.join(gone, rows[key] == gone["_dropped"], "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is fitted on the labels of the documents given."""
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; a null id is larger than others."""
    return without(docs, lambda rows, key: exact_dedup(rows, id_col=key).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links (five-word shingles, Jaccard 0.8) the smallest id stays; a
    null id is larger than others."""
    return without(docs, lambda rows, key: ngram_join(rows, id_col=key, words=5, percent=80).where("component_id <> doc_id"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with their cell's calibrated probability; the draw is by id and text."""
    return sample_mix(docs, draw=F.concat_ws(":", docs["doc_id"], F.md5(docs["text"])))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks with their bucket, batch and slot."""
    return pack_buckets(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixing), ("packing", packing)]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with Scratch(spark):  # what the stage wrote in between goes when its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

"""A corpus pipeline: from ``documents`` to token shards in training order.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is stored as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``:

1. toxicity: documents that the learned grammar scores at 0.5 or more go;
2. near_dedup: of each component of near copies the least doc_id stays, once;
3. decontamination: documents that contain a benchmark item go;
4. mixing: each document stays as often (0 to 2 times) as the mix takes it;
5. token_output: token ids of the mix in slots of a keyed permutation, stored as shards and read back.

Rows without a doc_id can't be named as copies and pass the second stage; null and empty
texts are neither toxic nor contaminated, but hold no words for the mix to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, mixing, near_dedup, token_shards, toxicity
from seqloom.runtime import materialized

#: Ids that are broadcast for an anti join, at most; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = toxicity.learned(spark, docs, sf_dir)
    scored = toxicity.score_toxicity(docs, grammar, score_col="__score")
    return scored.where(F.col("__score") < 0.5).drop("__score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialized(near_dedup.near_duplicates(docs).select("doc_id", "kept"))
    named = found.where(F.col("doc_id").isNotNull())
    gone = named.where(~F.col("kept")).select("doc_id").distinct()
    few = gone.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.limit(1).count() == 0:
        return left
    repeated = materialized(repeated)
    # of rows that share an id the one with the least hash stays, so that reruns agree
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.md5("text"))).alias("row"))
    return left.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select("row.*").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialized(docs)
    return docs


#: SQL can't express learning, tokenizing or the permutation; tests compare with a brute-force version.
ORACLE_SQL = None

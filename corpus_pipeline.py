"""From raw documents to shards of training text.

Each stage takes what its predecessor kept; the rows are written as Parquet
between stages. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, language, minhash, mixing, sharding
from tracewright.llm.queries import DOMAIN, SHARDS, held_out, table
from tracewright.session import settle

LEAST_SCORE = 0.2      # a language is told; only texts without one, or torn between all of them, go
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a language stay."""
    model = language.train(docs.where(~held_out()))
    found = language.identify(docs.select(*docs.columns), model)
    return found.where(f"lang_pred <> '{language.UNKNOWN}' and score >= {LEAST_SCORE}").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8) the row with the smallest id stays, null ids last.

    Rows are judged by their own text, also where ids are null or repeated. They
    get a written key first, so that each is decided once; rows of one id rank by
    a hash of all their columns.
    """
    key = max(docs.columns, key=len) + "_row"      # no column of the table
    own = F.concat_ws("-", F.xxhash64(F.to_json(F.struct(*docs.columns))), F.monotonically_increasing_id())
    keyed = settle(docs.withColumn(key, own), "pipeline-rows")
    kept = minhash.near_copies(keyed, row=key).where("kept").select(key)
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where("size(spans) = 0").select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as the target weights allow without repeating a document."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), F.expr(DOMAIN))
    mix = mixing.fit(docs, model, WEIGHTS, ceiling=1.0, keep_total=False)
    return mixing.apply(docs, mix).where("copies > 0").select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_domains), ("sharding", cut_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None      # learned models cannot be written in SQL

Q = {"pipeline": run}
SQL: dict[str, str] = {}

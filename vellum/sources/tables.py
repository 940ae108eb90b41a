"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines) of captured responses; a broken line doesn't stop the others."""
    raw = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    raw = raw.select("*", F.col("_broken").isNotNull().alias("_bad"))
    return raw.filter(~F.col("_bad")).drop("_broken", "_bad"), raw.filter("_bad").select(F.col("_broken").alias("line"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text) of text files whose pages are parted by form feeds."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\f")).alias("p", "text")).select("path", (F.col("p") + 1).alias("page_number"), "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade) of four columns parted by blanks; the last of repeated lines counts."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(t) >= 4).select(t[0].alias("query_id"), t[2].alias("doc_id"), t[3].cast("int").alias("grade"))
    return rows.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def overwrite_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Writes the partitions that ``df`` has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key, as an aggregation: no sort, partial results before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != at]
    one = df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("r"))
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in (at, *rest)])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows of both tables; for a key of both the newer row."""
    return newest(old.unionByName(new), keys, at)


def fresh(cache: DataFrame, now: str, days: int, at: str = "fetched_at") -> DataFrame:
    """Rows of a cache that haven't outlived ``days`` at ``now``."""
    return cache.filter(F.col(at) > F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days)))


def nodes_and_edges_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON element a row, as graph viewers read them: {"data": {...}}."""
    wrap = lambda df: df.select(F.to_json(F.struct(F.struct(*df.columns).alias("data"))).alias("element"))
    return wrap(nodes).unionByName(wrap(edges))

"""Near-duplicate statements: an exact Jaccard join by rare words, classes of equal statements, and what is kept of each."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import jaccard, statement_terms
from vellum.session import materialise


def folded(text: Column) -> Column:
    """NFKC and case folding; only texts beyond ASCII go through Python, in Arrow batches."""

    @F.pandas_udf("string")
    def fold(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    beyond = F.when(~text.rlike(r"^\p{ASCII}*$"), text)
    return F.coalesce(fold(beyond), F.lower(text))


def composed(text: Column) -> Column:
    """NFC; only texts beyond ASCII go through Python."""

    @F.pandas_udf("string")
    def compose(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(compose(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text)


def _prefix(sets: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, w, size): of n terms the rarest n - ceil(least n) + 1, of which sets that are near share one."""
    words = sets.select("id", F.explode("terms").alias("w"))
    ranked = words.join(counts, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
    size = F.size("r")
    return ranked.select("id", F.explode(F.slice("r", F.lit(1), size - F.ceil(size * least - 1e-9).cast("int") + 1)).alias("k"), size.alias("size")).select("id", F.col("k.w").alias("w"), "size")


def near_sets(a: DataFrame, b: DataFrame, least: float = 0.8, same: bool = False) -> DataFrame:
    """(a, b, jaccard) of sets (id, terms) with a Jaccard of ``least`` or more; ``same``: both are one table, pairs come once, a < b.

    Exact, whatever the words' frequencies: no word is dropped. Empty sets are near none.
    """
    a, b = (t.filter(F.size("terms") > 0).select("id", F.array_distinct("terms").alias("terms")) for t in (a, b))
    counts = (a if same else a.unionByName(b)).select(F.explode("terms").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    left = _prefix(a, counts, least).select(F.col("id").alias("a"), "w", F.col("size").alias("sa"))
    right = (_prefix(a, counts, least) if same else _prefix(b, counts, least)).select(F.col("id").alias("b"), "w", F.col("size").alias("sb"))
    pairs = left.join(right, "w").filter(F.least("sa", "sb") >= least * F.greatest("sa", "sb") - 1e-9)
    pairs = (pairs.filter("a < b") if same else pairs).select("a", "b").distinct()
    full = pairs.join(a.select(F.col("id").alias("a"), F.col("terms").alias("ta")), "a").join(b.select(F.col("id").alias("b"), F.col("terms").alias("tb")), "b")
    return full.withColumn("jaccard", F.round(jaccard(F.col("ta"), F.col("tb")), 6)).filter(F.col("jaccard") >= least).select("a", "b", "jaccard")


def statement_sets(rows: DataFrame, id_: str, statement: str) -> DataFrame:
    """(id, key, terms): the alphanumeric content of each statement and its set of terms, normalised and case-folded."""
    t = rows.select(F.col(id_).alias("id"), folded(F.coalesce(F.col(statement), F.lit(""))).alias("f"))
    return t.select("id", F.regexp_replace("f", r"[^\p{L}\p{M}\p{N}]+", "").alias("key"), statement_terms(F.col("f")).alias("terms"))


def without_duplicates(candidates: DataFrame, id_: str, statement: str, score: str, least: float = 0.8, by: list[str] | None = None, rounds: int = 50) -> DataFrame:
    """The candidates that a pass from the best to the worst keeps: one is dropped if it is near one that was kept. Adds ``merged``, how many were dropped for it.

    Of equal scores the smaller statement comes first, then the smaller id. Statements of the same alphanumeric content are near whatever
    their terms. Decided in rounds: a candidate without an undecided or kept better neighbour is kept, neighbours of kept ones are dropped; what
    was dropped counts for its best kept neighbour. Null statements are kept apart from others' terms.
    """
    order = F.row_number().over(Window.orderBy(F.desc(score), F.lower(statement), id_)) if not by else F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.lower(statement), id_))
    group = F.concat_ws("\u0001", *by) if by else F.lit("")
    c = materialise(candidates.withColumn("_place", order).withColumn("_grp", group), "candidates")
    sets = materialise(statement_sets(c, id_, statement), "sets")
    equal = sets.filter("key <> ''").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    star = equal.select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).filter("x < y")
    near = near_sets(sets.select("id", "terms"), sets.select("id", "terms"), least, True).select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(star).distinct()
    at = c.select(F.col(id_).alias("id"), "_place", "_grp")
    e = near.join(at.select(F.col("id").alias("x"), F.col("_place").alias("px"), F.col("_grp").alias("gx")), "x").join(at.select(F.col("id").alias("y"), F.col("_place").alias("py"), F.col("_grp").alias("gy")), "y").filter("gx = gy")
    swap = F.col("px") > F.col("py")
    edges = materialise(e.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("better"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("worse"), F.least("px", "py").alias("place")), "edges")
    dropped = None
    open_ = edges
    for _ in range(rounds):
        if open_.isEmpty():
            break
        kept = open_.select(F.col("better").alias("id")).distinct().join(open_.select(F.col("worse").alias("id")).distinct(), "id", "left_anti")
        gone = materialise(open_.join(kept.withColumnRenamed("id", "better"), "better").groupBy("worse").agg(F.min_by("better", "place").alias("into")), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        out = gone.select(F.col("worse").alias("id"))
        open_ = materialise(open_.join(out.withColumnRenamed("id", "worse"), "worse", "left_anti").join(out.withColumnRenamed("id", "better"), "better", "left_anti"), "open")
    if dropped is None:
        return c.withColumn("merged", F.lit(0).cast("long")).drop("_place", "_grp")
    n = dropped.groupBy(F.col("into").alias(id_)).agg(F.count("*").alias("merged"))
    return c.join(dropped.select(F.col("worse").alias(id_)), id_, "left_anti").join(n, id_, "left").withColumn("merged", F.coalesce("merged", F.lit(0))).drop("_place", "_grp")

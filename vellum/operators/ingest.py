"""Collecting, de-duplicating and structuring papers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import doi_key, title_key
from vellum.operators.components import connected_components


def collection_caps(rows: DataFrame, per_query: int, total: int, order: Column) -> DataFrame:
    """At most ``per_query`` rows of each (source_query, source) by result_rank, then the first ``total`` in ``order`` per source."""
    w = Window.partitionBy("source_query", "source").orderBy("result_rank", "item_id", "fetched_at")
    kept = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_query)
    t = Window.partitionBy("source").orderBy("n", order, "source_query")
    return kept.withColumn("place", F.row_number().over(t)).filter(F.col("place") <= total)


def upsert_by_doi(rows: DataFrame, arrival: Column) -> DataFrame:
    """One row per DOI: the newest title, of abstract and year the oldest known; rows without a DOI pass."""
    keyed = rows.withColumn("doi_key", doi_key(F.col("doi"))).withColumn("at", arrival)
    known = lambda c: F.min(F.when(c.isNotNull(), F.struct("at", "item_id", c.alias("v"))))["v"]
    one = keyed.filter(F.col("doi_key").isNotNull()).groupBy("doi_key").agg(
        F.max(F.struct("at", "item_id", "title"))["title"].alias("title"), known(F.when(F.col("abstract") != "", F.col("abstract"))).alias("abstract"), known(F.col("year")).alias("year"), F.count("*").alias("rows")
    )
    none = keyed.filter(F.col("doi_key").isNull()).select("doi_key", "title", F.when(F.col("abstract") != "", F.col("abstract")).alias("abstract"), "year", F.lit(1).cast("long").alias("rows"))
    return one.unionByName(none)


def identity_links(papers: DataFrame, paper: str = "paper_id", sources: DataFrame | None = None) -> DataFrame:
    """(a, b) links of each paper with the least paper of the same DOI, the same title, authors and year, or the same provider's id.

    ``sources``: (paper, provider, provider_id), any number of rows a paper. A star per signature, so a signature of many
    papers gives as many links as papers.
    """
    keys = F.array(F.concat(F.lit("d:"), doi_key(F.col("doi"))), F.concat(F.lit("t:"), title_key(F.col("title"), F.col("authors"), F.col("year"))))
    each = papers.select(F.col(paper).alias("b"), F.explode(keys).alias("key")).filter(F.col("key").isNotNull())
    if sources is not None:
        known = sources.filter("provider <> '' and provider_id <> ''").select(F.col(paper).alias("b"), F.concat_ws(":", F.lit("p"), "provider", "provider_id").alias("key")).distinct()
        each = each.unionByName(known.join(papers.select(F.col(paper).alias("b")).distinct(), "b", "left_semi"))
    least = each.groupBy("key").agg(F.min("b").alias("a"))
    return each.join(least, "key").select("a", "b").distinct()


def deduplicate(papers: DataFrame, paper: str = "paper_id", sources: DataFrame | None = None) -> DataFrame:
    """Papers with their canonical paper: the least id of the component that shared identities make."""
    found = connected_components(identity_links(papers, paper, sources))
    return papers.join(found.select(F.col("node").alias(paper), F.col("component").alias("canonical")), paper, "left").withColumn("canonical", F.coalesce("canonical", F.col(paper)))


def merge_fields(deduplicated: DataFrame, fields: list[str], paper: str = "paper_id", own: tuple[str, ...] = ("title",)) -> DataFrame:
    """One row per canonical paper: each field of the canonical paper, else the first of its duplicates' that isn't empty, by id.

    Fields of ``own`` are the canonical paper's whatever they hold.
    """
    filled = lambda c: F.when((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0"), F.col(c))
    first = lambda c: F.min(F.when(filled(c).isNotNull(), F.struct(F.col(paper).alias("p"), filled(c).alias("v"))))["v"].alias(c)
    mine = lambda c: F.max(F.when(F.col(paper) == F.col("canonical"), F.col(c))).alias(c)
    return deduplicated.groupBy("canonical").agg(*[mine(c) if c in own else first(c) for c in fields], F.count("*").alias("members"))


def moved_sources(sources: DataFrame, deduplicated: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Provenance rows pointed to the canonical paper, each once."""
    to = deduplicated.select(paper, "canonical")
    j = sources.join(to, paper, "left").withColumn(paper, F.coalesce("canonical", paper)).drop("canonical")
    return j.distinct()


def dedup_stats(deduplicated: DataFrame, paper: str = "paper_id") -> DataFrame:
    """One row: papers, components of more than one, and duplicates removed."""
    n = deduplicated.groupBy("canonical").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("papers"), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("components"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def collected(rows: DataFrame, failures: DataFrame, per_query: int, total: int, most_queries: int = 4) -> DataFrame:
    """(source, query_place, source_query, item_id, place, status, capped): a collection over the first ``most_queries`` different queries.

    ``rows``: (query_place, source_query, source, item_id, result_rank); ``failures``: (source, source_query, kind), of
    which "RATE_LIMITED" drops the source from that query on and any other kind only its query. Queries that differ in
    case and blanks are one. A source gives at most ``per_query`` rows a query and ``total`` in all; ``capped`` tells
    whether more were there, ``status`` is "success", or "partial" if anything of the collection failed.
    """
    plain = F.lower(F.trim(F.regexp_replace("source_query", r"\s+", " ")))
    q = rows.filter(plain != "").groupBy(plain.alias("q")).agg(F.min("query_place").alias("first")).orderBy("first", "q").limit(most_queries)
    r = rows.withColumn("q", plain).join(q, "q")
    f = failures.withColumn("q", plain).join(q, "q", "left")
    stop = f.filter("kind = 'RATE_LIMITED'").groupBy("source").agg(F.min("first").alias("stop"))
    r = r.join(f.filter("kind <> 'RATE_LIMITED'").select("source", "q").distinct(), ["source", "q"], "left_anti").join(stop, "source", "left").filter("stop is null or first < stop")
    r = r.groupBy("source", "first", "q", "item_id").agg(F.min("result_rank").alias("result_rank"))
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("source", "q").orderBy("result_rank", "item_id"))).withColumn("over", (F.col("n") > per_query).cast("int"))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("over", "first", "n"))).withColumn("capped", F.max(((F.col("over") == 1) | (F.col("place") > total)).cast("int")).over(Window.partitionBy("source")) == 1)
    failed = failures.agg((F.count("*") > 0).alias("failed"))
    kept = r.filter((F.col("over") == 0) & (F.col("place") <= total)).crossJoin(F.broadcast(failed))  # failed: one row
    return kept.select("source", F.col("first").alias("query_place"), F.col("q").alias("source_query"), "item_id", "place", F.when(F.col("failed"), "partial").otherwise("success").alias("status"), "capped")


def heading_sections(lines: DataFrame) -> DataFrame:
    """(paper_id, section, heading, body) from (paper_id, line_no, text, is_heading): lines up to the next heading; text before the first is dropped."""
    w = Window.partitionBy("paper_id").orderBy("line_no")
    numbered = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w)).filter("section > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    return numbered.groupBy("paper_id", "section").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"), text.alias("body"))


def embed_hashed(texts: DataFrame, text: str = "text", size: int = 128) -> DataFrame:
    """Adds ``embedding``: hashed words, of unit length; the offline stand-in for a model."""
    import zlib

    @F.pandas_udf("array<float>")
    def embed(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            v = np.zeros(size, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h & 0x80000000 else -1
            out.append(v / (np.linalg.norm(v) or 1))
        return pd.Series(out)

    return texts.withColumn("embedding", embed(F.col(text)))

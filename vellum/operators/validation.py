"""Validating gaps against evidence: classes, coverage, confidence, reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import doi_key
from vellum.operators.gaps import CUES

# Patterns that say a work solves something, or that a topic is widely studied.
SOLVES = r"(?i)\b(we (propose|present|introduce|develop|design|build|demonstrate|show)|this (paper|study|work) (proposes|presents|introduces|develops)|(a|an) (novel|new) (method|framework|approach|model|architecture|system|technique)|novel|(achieve[sd]?|attain(s|ed)?|obtain(s|ed)?|outperform(s|ed)?|surpass(es|ed)?|improve[sd]?|enable[sd]?)\b|state-of-the-art (performance|results))"
WIDELY = r"(?i)\b(has|have) been (widely|extensively|thoroughly|well|intensively) (studied|investigated|explored|addressed|researched)"
# Cut-offs of relevance; weights, caps and thresholds of the confidence.
IRRELEVANT, COUNTER_AT, SUPPORT_AT = 0.45, 0.62, 0.55
COUNTER_W, PARTIAL_W, CONTRADICTORY_W, GAP_W = 1.2, 0.6, 1.2, 2.0
COVERAGE_LOW, COVERAGE_HIGH, COVERAGE_PENALTY = 0.02, 0.15, 0.6
LEAST_ITEMS, LEAST_COVERAGE, CAP_FEW, LEAST_ADEQUACY, CAP_THIN = 3, 0.25, 0.39, 0.4, 0.69
PRIORITY = {"Contradictory": 5, "Counter": 4, "Supporting": 3, "Partial": 2, "Insufficient": 1}


def classify_evidence(hits: DataFrame) -> DataFrame:
    """Adds ``evidence_type`` by ordered rules on ``text``, ``relevance`` and ``coverage`` of the gap's concepts."""
    r, c, t = F.col("relevance"), F.col("coverage"), F.col("text")
    solves = t.rlike(SOLVES)
    states = t.rlike("|".join(f"(?:{p})" for _, _, p in CUES))
    kind = (
        F.when(r.isNull() | (r < IRRELEVANT), "Insufficient")
        .when(t.rlike(WIDELY) & (c >= 0.5), "Contradictory")
        .when(solves & (c >= 0.999) & (r >= COUNTER_AT), "Counter")
        .when(solves & ((c >= 0.5) | (r >= COUNTER_AT)), "Partial")
        .when(states & ((c >= 0.5) | (r >= SUPPORT_AT)), "Supporting")
        .otherwise("Insufficient")
    )
    return hits.withColumn("evidence_type", kind)


def aggregate_evidence(hits: DataFrame) -> DataFrame:
    """One row per gap and work: the hit of the highest (priority, strength); ``found_by`` lists the searches.

    A work is known by its DOI, else in the corpus by its paper, else by the
    letters of its title, else by its id. Ties go to the least hit_id.
    """
    title = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    work = F.coalesce(
        F.concat(F.lit("d:"), doi_key(F.col("doi"))), F.when(F.col("source") == "corpus", F.concat(F.lit("p:"), F.col("paper_id"))), F.when(F.length(title) > 0, F.concat(F.lit("t:"), title)), F.concat(F.lit("i:"), F.col("hit_id"))
    )
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("evidence_type")]
    best = F.max_by(F.struct("hit_id", "evidence_type", "strength"), F.struct(rank, "strength", "order"))
    ordered = hits.withColumn("order", -F.conv(F.substring(F.md5("hit_id"), 1, 8), 16, 10).cast("long"))
    g = ordered.groupBy("gap_id", work.alias("work")).agg(best.alias("b"), F.array_join(F.array_sort(F.collect_set("search")), "+").alias("found_by"), F.count("*").alias("hits"))
    return g.select("gap_id", "work", "b.evidence_type", "b.strength", "found_by", "hits")


def coverage_ratios(queries: DataFrame) -> DataFrame:
    """Per gap and kind of query the share of queries with a hit; null without queries of a kind."""
    return queries.groupBy("gap_id").pivot("kind", ["concept", "method", "retrieval", "terminology"]).agg(F.round(F.avg((F.col("hits") > 0).cast("double")), 6))


def confidence(gaps: DataFrame) -> DataFrame:
    """Adds ``confidence`` and ``cap`` to (gap_score, supporting, counter, partial, contradictory: masses; relevant, retrieval_coverage, adequacy, external_coverage)."""
    support = GAP_W * F.col("gap_score") + F.col("supporting")
    against = COUNTER_W * F.col("counter") + PARTIAL_W * F.col("partial") + CONTRADICTORY_W * F.col("contradictory")
    base = F.when(support + against > 0, support / (support + against)).otherwise(0.0)
    penalty = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("external_coverage") - COVERAGE_LOW) / (COVERAGE_HIGH - COVERAGE_LOW))), F.lit(0.0))
    penalty = F.when(F.col("external_coverage").isNull(), 0.0).otherwise(penalty)
    few = (F.col("relevant") < LEAST_ITEMS) | F.coalesce(F.col("retrieval_coverage") < LEAST_COVERAGE, F.lit(False))
    thin = F.coalesce(F.col("adequacy") < LEAST_ADEQUACY, F.lit(False))
    out = gaps.withColumn("support_mass", F.round(support, 4)).withColumn("counter_mass", F.round(against, 4)).withColumn("penalty", F.round(penalty, 4)).withColumn("raw", base * (1 - COVERAGE_PENALTY * penalty))
    capped = F.when(few, F.least("raw", F.lit(CAP_FEW))).when(thin, F.least("raw", F.lit(CAP_THIN))).otherwise(F.col("raw"))
    cap = F.when(few & (F.col("raw") > CAP_FEW), "insufficient").when(~few & thin & (F.col("raw") > CAP_THIN), "adequacy").otherwise("")
    return out.withColumn("confidence", F.round(capped, 4)).withColumn("cap", cap).drop("raw")


def classify(gaps: DataFrame) -> DataFrame:
    """Adds ``verdict`` by confidence and ``reason`` by ordered rules; ``structural``: found by counts only."""
    verdict = F.when(F.col("confidence") >= 0.70, "VALID_GAP").when(F.col("confidence") >= 0.40, "UNCERTAIN_GAP").otherwise("UNSUPPORTED_GAP")
    reason = (
        F.when(F.col("cap") == "insufficient", "INSUFFICIENT_EVIDENCE")
        .when(F.col("structural") & F.coalesce(F.col("external_coverage") >= 0.15, F.lit(False)), "CORPUS_ARTEFACT")
        .when(F.col("confidence") >= 0.70, "SUPPORTED")
        .when((F.col("penalty") >= 0.5) | (F.col("against_items") >= 2), "ADDRESSED_EXTERNALLY")
        .when(F.col("counter_mass") >= 0.5 * F.col("support_mass"), "CONTESTED")
        .otherwise("WEAK_SUPPORT")
    )
    return gaps.withColumn("verdict", verdict).withColumn("reason", reason)


def explanation(gaps: DataFrame) -> DataFrame:
    """Adds ``narrative``: one sentence on how the verdict came about."""
    return gaps.withColumn("narrative", F.format_string("%s (confidence %.2f, %s): support %.2f against %.2f from %d relevant works.", "verdict", "confidence", "reason", "support_mass", "counter_mass", "relevant"))


def verification_queries(gaps: DataFrame, aliases: DataFrame) -> DataFrame:
    """(gap_id, kind, query) from (gap_id, concepts, statement words): direct, by terms, by single concepts, and two counter queries.

    ``aliases``: (concept, alias); two per concept and three queries per gap at most swap a name for an alias.
    """
    joined = F.array_join("concepts", " ")
    direct = gaps.select("gap_id", F.explode(F.array(F.struct(F.lit("direct").alias("kind"), joined.alias("query")), F.struct(F.lit("direct").alias("kind"), F.array_join("words", " ").alias("query")), F.struct(F.lit("counter").alias("kind"), F.concat(joined, F.lit(" solved")).alias("query")), F.struct(F.lit("counter").alias("kind"), F.concat(joined, F.lit(" state of the art")).alias("query")))).alias("q")).select("gap_id", "q.kind", "q.query")
    single = gaps.select("gap_id", F.lit("refined").alias("kind"), F.explode("concepts").alias("query"))
    two = aliases.withColumn("n", F.row_number().over(Window.partitionBy("concept").orderBy("alias"))).filter("n <= 2")
    swapped = gaps.select("gap_id", "concepts", F.explode("concepts").alias("concept")).join(two, "concept")
    swapped = swapped.select("gap_id", F.lit("terminology").alias("kind"), F.array_join(F.transform("concepts", lambda c: F.when(c == F.col("concept"), F.col("alias")).otherwise(c)), " ").alias("query"))
    swapped = swapped.withColumn("n", F.row_number().over(Window.partitionBy("gap_id").orderBy("query"))).filter("n <= 3").drop("n")
    return direct.unionByName(single).unionByName(swapped).distinct()

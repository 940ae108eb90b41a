"""Validation queries: the items found for a query stand as evidence for a gap of that name."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.scores import evidence_strength
from vellum.operators import validation as V
from vellum.operators.gaps import CUES
from vellum.sources.tables import table


def _hits(spark, d):
    t = table(spark, d, "external_items").distinct()
    hits = t.select(
        F.col("source_query").alias("gap_id"), "item_id", "title", "doi", "year", F.col("source").alias("search"), F.lit("external").alias("source"), F.col("item_id").alias("paper_id"),
        F.concat_ws("/", "item_id", F.date_format("fetched_at", "yyyyMMddHHmmssSSSSSS"), "result_rank").alias("hit_id"), F.coalesce("abstract", F.lit("")).alias("text"),
        F.round(1 / (1 + F.col("result_rank") / 25.0), 6).alias("relevance"), ((F.col("result_rank") % 5) / 4.0).alias("coverage"),
    )
    kinds = V.classify_evidence(hits)
    return kinds.withColumn("strength", evidence_strength(F.col("relevance"), F.expr("nullif(year, 0)"), F.lit(2020), F.col("source")))


def evidence_classify(spark, d):
    return _hits(spark, d).groupBy("gap_id", "evidence_type").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("mass"))


def evidence_dedup_priority(spark, d):
    return V.aggregate_evidence(_hits(spark, d)).groupBy("gap_id", "found_by").agg(F.count("*").alias("works"), F.sum("hits").alias("hits"), F.round(F.sum("strength"), 4).alias("mass"))


def coverage_ratios(spark, d):
    t = table(spark, d, "external_items").groupBy(F.col("source_query").alias("gap_id"), "source").agg(F.max("result_rank").alias("r"), F.count("*").alias("n"))
    kinds = F.element_at(F.array(*map(F.lit, ("concept", "method", "retrieval", "terminology"))), (F.col("r") % 4 + 1).cast("int"))
    return V.coverage_ratios(t.select("gap_id", kinds.alias("kind"), (F.col("n") % 3).alias("hits")))


def _gaps(spark, d):
    h = _hits(spark, d)
    mass = lambda k: F.round(F.sum(F.when(F.col("evidence_type") == k, F.col("strength")).otherwise(0.0)), 4)
    g = h.groupBy("gap_id").agg(
        mass("Supporting").alias("supporting"), mass("Counter").alias("counter"), mass("Partial").alias("partial"), mass("Contradictory").alias("contradictory"),
        F.sum((F.col("evidence_type") != "Insufficient").cast("int")).alias("relevant"), F.sum(F.col("evidence_type").isin("Counter", "Contradictory").cast("int")).alias("against_items"), F.count("*").alias("n"),
    )
    return g.select(
        "*", ((F.col("n") % 10) / 10.0).alias("gap_score"), ((F.col("n") % 4) / 4.0).alias("retrieval_coverage"), ((F.col("n") % 5) / 5.0).alias("adequacy"),
        F.when(F.col("n") % 3 != 0, (F.col("n") % 20) / 100.0).alias("external_coverage"), (F.col("n") % 2 == 0).alias("structural"),
    )


def confidence_caps(spark, d):
    return V.confidence(_gaps(spark, d)).select("gap_id", "support_mass", "counter_mass", "penalty", "confidence", "cap")


def classify_reason(spark, d):
    return V.classify(V.confidence(_gaps(spark, d))).groupBy("verdict", "reason").agg(F.count("*").alias("n"))


def gap_narrative(spark, d):
    return V.explanation(V.classify(V.confidence(_gaps(spark, d)))).select("gap_id", "narrative")


_STATES = " OR ".join(f"regexp_matches(text, '{p}')" for _, _, p in CUES)
HITS_SQL = f"""WITH i AS (SELECT DISTINCT * FROM external_items), h0 AS (SELECT source_query AS gap_id, item_id, title, doi, year, source AS search, coalesce(abstract, '') AS text, round(1 / (1 + result_rank / 25.0), 6) AS relevance, (result_rank % 5) / 4.0 AS coverage FROM i),
h1 AS (SELECT *, regexp_matches(text, '{V.SOLVES}') AS solves, {_STATES} AS states FROM h0),
h AS (SELECT *, CASE WHEN relevance < 0.45 THEN 'Insufficient' WHEN regexp_matches(text, '{V.WIDELY}') AND coverage >= 0.5 THEN 'Contradictory' WHEN solves AND coverage >= 0.999 AND relevance >= 0.62 THEN 'Counter'
 WHEN solves AND (coverage >= 0.5 OR relevance >= 0.62) THEN 'Partial' WHEN states AND (coverage >= 0.5 OR relevance >= 0.55) THEN 'Supporting' ELSE 'Insufficient' END AS evidence_type,
 round(relevance * (CASE WHEN nullif(year, 0) IS NULL THEN 0.9 WHEN year > 2020 THEN 1.0 ELSE 0.8 END) * 0.9, 4) AS strength FROM h1)"""
GAPS_SQL = (
    HITS_SQL
    + """, g0 AS (SELECT gap_id, round(sum(CASE WHEN evidence_type = 'Supporting' THEN strength ELSE 0 END), 4) AS su, round(sum(CASE WHEN evidence_type = 'Counter' THEN strength ELSE 0 END), 4) AS co, round(sum(CASE WHEN evidence_type = 'Partial' THEN strength ELSE 0 END), 4) AS pa,
 round(sum(CASE WHEN evidence_type = 'Contradictory' THEN strength ELSE 0 END), 4) AS cn, sum((evidence_type <> 'Insufficient')::INT) AS relevant, sum((evidence_type IN ('Counter', 'Contradictory'))::INT) AS against_items, count(*) AS n FROM h GROUP BY gap_id),
g1 AS (SELECT *, 2 * (n % 10) / 10.0 + su AS sup, 1.2 * co + 0.6 * pa + 1.2 * cn AS con, (n % 4) / 4.0 AS rc, (n % 5) / 5.0 AS ad, CASE WHEN n % 3 <> 0 THEN (n % 20) / 100.0 END AS ec FROM g0),
g2 AS (SELECT *, CASE WHEN ec IS NULL THEN 0 ELSE least(1.0, greatest(0.0, (ec - 0.02) / 0.13)) END AS pen, relevant < 3 OR rc < 0.25 AS few, ad < 0.4 AS thin FROM g1),
g3 AS (SELECT *, (CASE WHEN sup + con > 0 THEN sup / (sup + con) ELSE 0 END) * (1 - 0.6 * pen) AS raw FROM g2),
g AS (SELECT gap_id, n, ec, against_items, relevant, round(sup, 4) AS support_mass, round(con, 4) AS counter_mass, round(pen, 4) AS penalty, round(CASE WHEN few THEN least(raw, 0.39) WHEN thin THEN least(raw, 0.69) ELSE raw END, 4) AS confidence,
 CASE WHEN few AND raw > 0.39 THEN 'insufficient' WHEN NOT few AND thin AND raw > 0.69 THEN 'adequacy' ELSE '' END AS cap FROM g3)"""
)
QUERIES = {f.__name__: f for f in (evidence_classify, evidence_dedup_priority, coverage_ratios, confidence_caps, classify_reason, gap_narrative)}
ORACLES = {
    "evidence_classify": HITS_SQL + " SELECT gap_id, evidence_type, count(*) AS n, round(sum(strength), 4) AS mass FROM h GROUP BY ALL",
    "evidence_dedup_priority": HITS_SQL
    + r""", k AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(trim(lower(doi)), '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', '')), '') AS dk, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS tk FROM h),
w AS (SELECT *, coalesce('d:' || dk, CASE WHEN length(tk) > 0 THEN 't:' || tk END, 'i:' || item_id || row_number() OVER ()) AS work, CASE evidence_type WHEN 'Contradictory' THEN 5 WHEN 'Counter' THEN 4 WHEN 'Supporting' THEN 3 WHEN 'Partial' THEN 2 ELSE 1 END AS p FROM k),
a AS (SELECT gap_id, work, max(struct_pack(p := p, s := strength)).s AS s, string_agg(DISTINCT search, '+' ORDER BY search) AS found_by, count(*) AS hits FROM w GROUP BY gap_id, work)
SELECT gap_id, found_by, count(*) AS works, sum(hits)::BIGINT AS hits, round(sum(s), 4) AS mass FROM a GROUP BY ALL""",
    "coverage_ratios": """WITH t AS (SELECT source_query AS gap_id, source, max(result_rank) % 4 AS k, count(*) % 3 > 0 AS hit FROM external_items GROUP BY ALL)
SELECT gap_id, round(avg(hit::INT) FILTER (k = 0), 6) AS concept, round(avg(hit::INT) FILTER (k = 1), 6) AS method, round(avg(hit::INT) FILTER (k = 2), 6) AS retrieval, round(avg(hit::INT) FILTER (k = 3), 6) AS terminology FROM t GROUP BY gap_id""",
    "confidence_caps": GAPS_SQL + " SELECT gap_id, support_mass, counter_mass, penalty, confidence, cap FROM g",
    "classify_reason": GAPS_SQL
    + """ SELECT CASE WHEN confidence >= 0.7 THEN 'VALID_GAP' WHEN confidence >= 0.4 THEN 'UNCERTAIN_GAP' ELSE 'UNSUPPORTED_GAP' END AS verdict, CASE WHEN cap = 'insufficient' THEN 'INSUFFICIENT_EVIDENCE' WHEN n % 2 = 0 AND coalesce(ec >= 0.15, false) THEN 'CORPUS_ARTEFACT'
 WHEN confidence >= 0.7 THEN 'SUPPORTED' WHEN penalty >= 0.5 OR against_items >= 2 THEN 'ADDRESSED_EXTERNALLY' WHEN counter_mass >= 0.5 * support_mass THEN 'CONTESTED' ELSE 'WEAK_SUPPORT' END AS reason, count(*) AS n FROM g GROUP BY ALL""",
}

"""Gap detection and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.scores import recency
from vellum.operators import gaps as P
from vellum.operators.graph import TYPE_PAIRS
from vellum.operators.ingest import embed_hashed
from vellum.operators import evidence as E
from vellum.plans import graph
from vellum.plans import knowledge as K
from vellum.sources.tables import newest, table


def gap_statements(spark, d):
    """Statements of gaps in all sections, each once per paper."""
    t = table(spark, d, "sections").filter("text is not null and paper_id is not null")
    g = P.gap_statements(t, "section_id", "title", "paper_id")
    return g.groupBy("section_type", "cue").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.round(F.sum("strength"), 4).alias("strength"))


def explicit_support(spark, d):
    t = table(spark, d, "documents").filter("text is not null and paper_id is not null")
    return P.explicit_support(P.gap_statements(t, "doc_id", None, "paper_id"), ["cue"], "paper_id")


def combination_sparsity(spark, d):
    """The reference thresholds over the entities of the on-topic papers that are neither generic nor part of the run's question."""
    pairs = spark.createDataFrame(TYPE_PAIRS, "ta string, tb string")
    r = K.Run(spark, d)
    return P.combination_sparsity(K.specific_papers(r), K.on_topic_sizes(r), K.on_topic_edges(r), pairs, limit=15)


def combination_sparsity_loose(spark, d):
    """The same with thresholds at which the invented tables have rows."""
    pairs = spark.createDataFrame(TYPE_PAIRS, "ta string, tb string")
    r = K.Run(spark, d)
    return P.combination_sparsity(K.specific_papers(r), K.on_topic_sizes(r), K.on_topic_edges(r), pairs, 3, 0.95, 0.5, 0.01)


def _years(spark, d):
    p = newest(table(spark, d, "kg_papers").select("run_id", "paper_id", "built_at", "publication_year"), ["run_id", "paper_id"], "built_at").filter("publication_year > 0")
    return p.select("run_id", "paper_id", F.col("publication_year").alias("year"))


def internal_staleness(spark, d):
    years = _years(spark, d)
    per_entity = graph.entity_paper(spark, d).join(years, ["run_id", "paper_id"]).groupBy("run_id", "entity", "year").agg(F.count("*").alias("papers"))
    return P.internal_staleness(per_entity, years.groupBy("run_id", "year").agg(F.count("*").alias("total")))


def external_staleness(spark, d):
    t = table(spark, d, "documents").filter("publication_year is not null and venue is not null")
    field = t.groupBy(F.col("publication_year").alias("year")).agg(F.count("*").alias("field"))
    venues = t.select("venue").distinct()
    have = t.groupBy("venue", F.col("publication_year").alias("year")).agg(F.count("*").alias("papers"))
    grid = venues.join(F.broadcast(field)).join(have, ["venue", "year"], "left").na.fill(0, ["papers"])  # a row per year
    return P.external_staleness(grid, ["venue"], 2024)


def topic_density(spark, d):
    return P.topic_density(table(spark, d, "embeddings"))


def _scored(spark, d):
    e = table(spark, d, "kg_edges").distinct().select("run_id", "a", "b", "papers", "pmi", "built_at")
    one = newest(e, ["run_id", "a", "b"], "built_at")
    f = one.select(
        "run_id", F.concat_ws("~", "a", "b").alias("statement"), F.element_at(F.split("a", ":"), 1).alias("kind"),
        F.round(1 - F.exp(-F.col("papers") / 2.0), 6).alias("explicit"), F.when(F.col("pmi") <= 4, F.round(1 - F.col("pmi") / 4, 6)).alias("sparsity"),
        F.when(F.col("papers") % 3 != 0, F.round((F.col("papers") % 7) / 7.0, 6)).alias("staleness"), F.round(F.least(F.lit(1.0), F.col("papers") / 3.0), 6).alias("independence"),
        ((F.col("papers") % 4) / 3.0).alias("agreement"),
    )
    return P.gap_score(f, F.col("agreement"))


def gap_score(spark, d):
    return _scored(spark, d).select("run_id", "statement", "gap_score")


def diversity_rank(spark, d):
    return P.diversity_rank(_scored(spark, d), "gap_score", "kind", "statement", by=["run_id"]).select("run_id", "statement", "rank_score", "rank")


def candidate_rank(spark, d):
    return P.diversity_rank(_scored(spark, d), "gap_score", "kind", "statement", 0.1, None, True, ["run_id"]).select("run_id", "statement", "rank_score", "rank")


def candidate_prescore(spark, d):
    t = table(spark, d, "external_items").distinct()
    items = t.select(
        F.col("source_query").alias("gap_id"), F.col("item_id").alias("paper_id"), F.when(F.col("result_rank") % 4 == 0, "COUNTER").otherwise("SUPPORTING").alias("stance"),
        F.round(1 / (1 + F.col("result_rank") / 25.0), 6).alias("relevance"), F.when(F.col("result_rank") % 3 == 0, 1.0).otherwise(0.5).alias("quality"), F.round(recency(F.expr("nullif(year, 0)"), F.lit(2024)), 6).alias("recency"),
    )
    return P.prescore(items)


def consensus_clusters(spark, d):
    t = table(spark, d, "test_items").select("suite", F.col("text").alias("statement"))
    return P.consensus_clusters(embed_hashed(t, "statement"), "suite")


def _cue_sql() -> tuple[str, str]:
    hit = " ".join(f"WHEN regexp_matches(sentence, '{p}') THEN '{n}'" for n, _, p in P.CUES)
    base = " ".join(f"WHEN '{n}' THEN {s}" for n, s, _ in P.CUES)
    return f"CASE {hit} END", f"CASE cue {base} END"


_HIT, _BASE = _cue_sql()
_WEIGHT = "CASE section_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.SECTION_WEIGHTS.items()) + " ELSE 0.5 END"
_RULES = [E.SELF_REFERENCE.replace("|we (propose|present|introduce|develop|developed|proposed) (a|an|the)\\b(?!.*\\b(lack|limited|fail|challenge))", ""), E.CONTRIBUTION, E.MOTIVATION, E.PAGE_HEADER, E.CITATION_RUN, E.TABLE_HEADER, E.TABLE_LIKE, E.TABLE_ROWS]  # the branch left out is one of CONTRIBUTION's too
_KEPT = " AND ".join(f"NOT regexp_matches(sentence, '{p}')" for p in _RULES)


def _statement_sql(source: str) -> str:
    """Statements st(owner, k, section_type, sentence, cue, strength) of a source (owner, k, section_type, title, text)."""
    weight = f"CASE WHEN regexp_matches(coalesce(title, ''), '{P.GAP_HEADING}') THEN greatest(0.9, {_WEIGHT}) ELSE {_WEIGHT} END".replace("CASE section_type", "CASE upper(section_type)")
    return rf"""t AS (SELECT owner, k, section_type, title, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS x FROM ({source})),
s AS (SELECT owner, k, section_type, title, unnest(string_split(regexp_replace(x, '([.!?]) +([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM t),
w AS (SELECT *, {_HIT} AS cue, len(string_split(sentence, ' ')) AS n, len(list_filter(string_split(sentence, ' '), lambda v: regexp_matches(v, '^\p{{Lu}}')))::DOUBLE / len(string_split(sentence, ' ')) AS cap FROM s WHERE len(string_split(sentence, ' ')) BETWEEN 8 AND 70),
k AS (SELECT *, round({_BASE} * {weight}, 4)::DOUBLE AS strength FROM w WHERE cue IS NOT NULL AND {_KEPT} AND NOT starts_with(ltrim(sentence), '[') AND NOT (cap > 0.55 OR (n > 15 AND cap > 0.42))),
o AS (SELECT owner, min(struct_pack(k := k, t := section_type, s := sentence, c := cue, st := strength)) AS r FROM k GROUP BY owner, lower(sentence)),
st AS (SELECT owner, r.k AS k, r.t AS section_type, r.s AS sentence, r.c AS cue, r.st AS strength FROM o)"""


SCORED_SQL = """WITH e AS (SELECT run_id, a, b, max(struct_pack(t := built_at, p := papers, i := pmi)) AS r FROM kg_edges GROUP BY run_id, a, b),
v AS (SELECT run_id, a || '~' || b AS statement, split_part(a, ':', 1) AS kind, r.p AS papers, round(1 - exp(-r.p / 2.0), 6) AS ex, CASE WHEN r.i <= 4 THEN round(1 - r.i / 4, 6) END AS sp,
 CASE WHEN r.p % 3 <> 0 THEN round((r.p % 7) / 7.0, 6) END AS sl, round(least(1.0, r.p / 3.0), 6) AS ind, (r.p % 4) / 3.0 AS ag FROM e),
g AS (SELECT *, round(least(1.0, (ex * 0.25 + coalesce(sp * 0.25, 0) + coalesce(sl * 0.15, 0) + ind * 0.15) / (0.4 + CASE WHEN sp IS NULL THEN 0 ELSE 0.25 END + CASE WHEN sl IS NULL THEN 0 ELSE 0.15 END) + 0.1 * ag), 4) AS gap_score FROM v)"""
def combination_sql(most_lift: float, least_expected: float, least_link: float, limit: int | None) -> str:
    return K.BASE + f""", u AS (SELECT entity, run_id, papers AS f, n, split_part(entity, ':', 1) AS kind FROM fl JOIN nt USING (run_id) WHERE papers >= 3 AND specific),
p AS (SELECT x.run_id, x.entity AS a, y.entity AS b, x.f AS fa, y.f AS fb, x.f * y.f / x.n::DOUBLE AS expected FROM u x JOIN (VALUES {PAIRS_SQL}) t(ta, tb) ON x.kind = ta JOIN u y ON y.run_id = x.run_id AND y.kind = tb WHERE x.f * y.f / x.n::DOUBLE >= {least_expected}),
o AS (SELECT p.*, coalesce(edt.papers, 0) AS observed FROM p LEFT JOIN edt ON edt.run_id = p.run_id AND edt.a = least(p.a, p.b) AND edt.b = greatest(p.a, p.b)),
l AS (SELECT *, observed / expected AS lift FROM o WHERE observed / expected <= {most_lift}),
w AS (SELECT run_id, a, b FROM edt WHERE pmi > 0 UNION ALL SELECT run_id, b, a FROM edt WHERE pmi > 0), nb AS (SELECT run_id, a AS e, list(b) AS near FROM w GROUP BY ALL),
k AS (SELECT l.*, list_filter(coalesce(x.near, []), lambda v: v <> l.b) AS na, list_filter(coalesce(y.near, []), lambda v: v <> l.a) AS nb FROM l LEFT JOIN nb x ON x.run_id = l.run_id AND x.e = l.a LEFT JOIN nb y ON y.run_id = l.run_id AND y.e = l.b),
z AS (SELECT *, CASE WHEN len(na) + len(nb) > 0 THEN len(list_intersect(na, nb)) / (len(na) + len(nb) - len(list_intersect(na, nb)))::DOUBLE ELSE 0 END AS link FROM k),
q AS (SELECT run_id, a, b, fa, fb, observed, round(expected, 3) AS expected, round(lift, 4) AS lift, round(1 - least(lift, 1), 4) AS sparsity, round(link, 4) AS link, round((1 - least(lift, 1)) * (0.5 + 0.5 * link), 4) AS score FROM z WHERE link >= {least_link} AND a <> b)
SELECT * FROM q{f" QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score DESC, a, b) <= {limit}" if limit else ""}"""


PAIRS_SQL = ", ".join(f"('{a}','{b}')" for a, b in TYPE_PAIRS)
QUERIES = {f.__name__: f for f in (gap_statements, explicit_support, combination_sparsity, combination_sparsity_loose, internal_staleness, external_staleness, topic_density, gap_score, diversity_rank, candidate_rank, candidate_prescore, consensus_clusters)}
ORACLES = {
    "gap_statements": f"WITH {_statement_sql('SELECT paper_id AS owner, section_id AS k, section_type, title, text FROM sections WHERE text IS NOT NULL AND paper_id IS NOT NULL')} SELECT section_type, cue, count(*) AS n, count(DISTINCT owner) AS papers, round(sum(strength), 4) AS strength FROM st GROUP BY ALL",
    "explicit_support": f"WITH {_statement_sql('SELECT paper_id AS owner, doc_id AS k, section_type, NULL AS title, text FROM documents WHERE text IS NOT NULL AND paper_id IS NOT NULL')}, b AS (SELECT cue, owner, max(strength) AS s FROM st GROUP BY ALL) SELECT cue, count(*) AS papers, round(sum(s), 6) AS support, round(1 - exp(-sum(s) / 2), 6) AS explicit FROM b GROUP BY cue",
    "combination_sparsity": combination_sql(0.35, 1.5, 0.25, 15),
    "combination_sparsity_loose": combination_sql(0.95, 0.5, 0.01, None),
    "internal_staleness": graph.BASE
    + """, py AS (SELECT run_id, paper_id, max(struct_pack(t := built_at, y := publication_year)).y AS year FROM kg_papers GROUP BY ALL), yy AS (SELECT * FROM py WHERE year > 0),
ey AS (SELECT run_id, entity, year, count(*) AS papers FROM ep JOIN yy USING (run_id, paper_id) GROUP BY ALL), ty AS (SELECT run_id, year, count(*) AS total FROM yy GROUP BY ALL),
rf AS (SELECT run_id, max(year) AS ref FROM ty GROUP BY run_id), la AS (SELECT run_id, entity, max(year) AS last_year FROM ey GROUP BY ALL),
gr AS (SELECT la.run_id, la.entity, last_year, ref, ty.year, coalesce(ey.papers, 0) / total::DOUBLE AS share FROM la JOIN rf USING (run_id) JOIN ty ON ty.run_id = la.run_id AND ty.year > ref - 5 LEFT JOIN ey ON ey.run_id = la.run_id AND ey.entity = la.entity AND ey.year = ty.year),
sl AS (SELECT run_id, entity, max(last_year) AS last_year, max(ref) AS ref, coalesce(regr_slope(share, year::DOUBLE), 0) AS slope FROM gr GROUP BY ALL)
SELECT run_id, entity, last_year, round(slope, 4) AS slope, round(0.6 * least(1.0, (ref - last_year) / 5.0) + 0.4 / (1 + exp(20 * slope)), 4) AS tau FROM sl""",
    "external_staleness": """WITH t AS (SELECT * FROM documents WHERE publication_year IS NOT NULL AND venue IS NOT NULL), fd AS (SELECT publication_year AS year, count(*) AS field FROM t GROUP BY 1),
g AS (SELECT v.venue, fd.year, field, count(t.doc_id) AS papers FROM (SELECT DISTINCT venue FROM t) v CROSS JOIN fd LEFT JOIN t ON t.venue = v.venue AND t.publication_year = fd.year WHERE fd.year < 2024 AND fd.year >= 2018 GROUP BY ALL),
r AS (SELECT *, papers / field::DOUBLE AS share, row_number() OVER (PARTITION BY venue ORDER BY year DESC) AS k FROM g),
a AS (SELECT venue, count(*) AS n, avg(share) AS share, regr_slope(share, year::DOUBLE) AS slope, sum(CASE WHEN k <= 2 THEN papers ELSE 0 END) AS r FROM r GROUP BY venue HAVING count(*) >= 3)
SELECT venue, round(share, 5) AS share, round(CASE WHEN share <= 0 OR r = 0 THEN 1 ELSE 1 / (1 + exp(8 * slope / share)) END, 4) AS tau FROM a""",
    "topic_density": "WITH n AS (SELECT label, count(*) AS papers FROM embeddings GROUP BY label) SELECT label, papers, round(least(1.0, papers / (SELECT median(papers) FROM n WHERE papers > 1)), 6) AS density FROM n",
    "gap_score": SCORED_SQL + " SELECT run_id, statement, gap_score FROM g",
    "diversity_rank": SCORED_SQL
    + """, j AS (SELECT *, round(gap_score - 0.05 * least(row_number() OVER (PARTITION BY run_id, kind ORDER BY gap_score DESC, statement DESC) - 1, 2), 6) AS rank_score FROM g)
SELECT run_id, statement, rank_score, row_number() OVER (PARTITION BY run_id ORDER BY rank_score DESC, gap_score DESC, statement DESC) AS rank FROM j""",
    "candidate_rank": SCORED_SQL
    + """, j AS (SELECT *, round(gap_score - 0.1 * (row_number() OVER (PARTITION BY run_id, kind ORDER BY gap_score DESC, statement) - 1), 6) AS rank_score FROM g)
SELECT run_id, statement, rank_score, row_number() OVER (PARTITION BY run_id ORDER BY rank_score DESC, gap_score DESC, statement) AS rank FROM j""",
    "candidate_prescore": """WITH i AS (SELECT DISTINCT * FROM external_items), x AS (SELECT source_query AS gap_id, item_id, result_rank % 4 <> 0 AS sup, round(1 / (1 + result_rank / 25.0), 6) AS rel, CASE WHEN result_rank % 3 = 0 THEN 1.0 ELSE 0.5 END AS q0,
 CASE WHEN nullif(year, 0) IS NOT NULL THEN round(greatest(0.0, 1.0 - greatest(0, 2024 - year) / 10.0), 6) END AS rec FROM i), y AS (SELECT *, CASE WHEN sup THEN q0 END AS q FROM x),
s AS (SELECT *, (rel * 0.35 + coalesce(q * 0.2, 0) + coalesce(rec * 0.15, 0)) / (0.35 + CASE WHEN q IS NULL THEN 0 ELSE 0.2 END + CASE WHEN rec IS NULL THEN 0 ELSE 0.15 END) AS st FROM y),
g AS (SELECT gap_id, avg(rel) FILTER (sup) AS r, avg(q) FILTER (sup) AS q, avg(rec) FILTER (sup) AS c, count(DISTINCT item_id) FILTER (sup) AS p, coalesce(sum(st) FILTER (sup), 0) AS f, coalesce(sum(st) FILTER (NOT sup), 0) AS a, count(*) FILTER (sup) AS n FROM s GROUP BY gap_id),
h AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END WHEN f + a > 0 THEN a / (f + a) ELSE 0 END AS ratio,
 CASE WHEN n = 0 THEN 0 ELSE (r * 0.35 + q * 0.2 + coalesce(c * 0.15, 0) + least(p / 3.0, 1) * 0.3) / (0.85 + CASE WHEN c IS NULL THEN 0 ELSE 0.15 END) END AS sup FROM g)
SELECT gap_id, round(sup, 6) AS support_score, round(ratio, 6) AS contradiction_ratio, round(sup * (1 - ratio), 6) AS score, CASE WHEN n = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN ratio = 0 THEN 'SUPPORTED' WHEN ratio < 0.5 THEN 'CONTESTED' ELSE 'CONTRADICTED' END AS status FROM h""",
}

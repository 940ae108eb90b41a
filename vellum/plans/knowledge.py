"""Queries on the graph of each run's on-topic papers: flags, cores, trends, topics, fusion and scores."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions.text import term_key
from vellum.operators import gaps as P
from vellum.operators import graph as G
from vellum.operators import signals as S
from vellum.plans import graph
from vellum.session import materialise
from vellum.sources.tables import newest, table


class Run:
    """The tables of one query: what several steps share is written once to the shared folder."""

    def __init__(self, spark, d):
        self.spark, self.d, self.held = spark, d, {}


def once(build):
    """A step whose table is written at its first use in a query and read afterwards."""

    @wraps(build)
    def held(r, *args):
        key = (build.__name__, *args)
        if key not in r.held:
            r.held[key] = materialise(build(r, *args), build.__name__.strip("_"))
        return r.held[key]

    return held


@once
def on_topic(r):
    return newest(table(r.spark, r.d, "kg_papers"), ["run_id", "paper_id"], "built_at").filter("on_topic").select("run_id", "paper_id", "title", F.when(F.col("publication_year") > 0, F.col("publication_year")).alias("year"), "relevance")


def on_topic_sizes(r):
    return on_topic(r).groupBy("run_id").agg(F.count("*").alias("n"))


@once
def on_topic_mentions(r):
    return G.newest_mentions(table(r.spark, r.d, "kg_mentions")).join(on_topic(r).select("run_id", "paper_id"), ["run_id", "paper_id"], "left_semi")


@once
def on_topic_papers(r):
    return G.entity_papers(table(r.spark, r.d, "kg_mentions")).join(on_topic(r).select("run_id", "paper_id"), ["run_id", "paper_id"], "left_semi")


@once
def on_topic_edges(r):
    return G.cooccurrence(on_topic_papers(r), on_topic_sizes(r))


def _questions(r):
    """The title of each run's most relevant paper stands for its question."""
    return on_topic(r).groupBy("run_id").agg(F.max(F.struct("relevance", "paper_id", "title"))["title"].alias("question"))


@once
def entities(r):
    roll = G.rollup(on_topic_papers(r), on_topic_sizes(r))
    names = table(r.spark, r.d, "kg_entities").select(F.concat_ws(":", F.upper(F.trim("entity_type")), term_key(F.col("name"))).alias("entity"), F.coalesce("aliases", F.array().cast("array<string>")).alias("a"))
    names = names.groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("aliases"))
    return S.flagged_entities(roll.join(names, "entity", "left"), _questions(r))


def specific_papers(r):
    return on_topic_papers(r).join(entities(r).filter("specific").select("run_id", "entity"), ["run_id", "entity"], "left_semi")


def entity_flags(spark, d):
    r = Run(spark, d)
    return entities(r).select("run_id", "entity", "papers", "generic", "query_term", "specific")


def _chunk_statements(r):
    """Each chunk as a statement of its paper, about the entities it mentions."""
    return on_topic_mentions(r).groupBy("run_id", F.col("chunk_id").alias("statement_id"), "paper_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))


def specific_statements(spark, d):
    r = Run(spark, d)
    return S.specific_statements(_chunk_statements(r), entities(r)).groupBy("run_id").agg(F.count("*").alias("statements"), F.count_distinct("paper_id").alias("papers"))


@once
def _cores(r):
    return S.core_entities(_chunk_statements(r).withColumnRenamed("paper_id", "cluster"), entities(r))


def core_entities(spark, d):
    r = Run(spark, d)
    return _cores(r).select("run_id", F.col("cluster").alias("paper_id"), F.array_join("core", " | ").alias("core"))


def field_anchors(spark, d):
    """Anchors where every specific entity of a concept-like type counts as a term of the question."""
    r = Run(spark, d)
    e = entities(r).withColumn("entity", F.regexp_replace("entity", "^(TASK|METHOD):", "CONCEPT:")).withColumn("query_term", F.col("papers") >= 3)
    return S.field_anchor(e)


def _yearly(r):
    t = on_topic(r).filter("year is not null").select("run_id", "paper_id", "year")
    per = on_topic_papers(r).join(t, ["run_id", "paper_id"]).groupBy("run_id", "entity", "year").agg(F.count("*").alias("papers"))
    return t, per


@once
def staleness(r):
    """Trends within each run, and those over the papers of all runs where an entity has them."""
    t, per = _yearly(r)
    own = P.internal_staleness(per, t.groupBy("run_id", "year").agg(F.count("*").alias("total")))
    field = t.groupBy("year").agg(F.count("*").alias("field"))
    world = per.groupBy("entity", "year").agg(F.sum("papers").alias("papers"))
    grid = per.select("entity").distinct().join(F.broadcast(field)).join(world, ["entity", "year"], "left").na.fill(0, ["papers"])  # field: a row per year
    other = P.external_staleness(grid, ["entity"], 2025).join(per.groupBy("run_id", "entity").agg(F.sum("papers").alias("n")).filter("n >= 4"), "entity")
    spans = t.groupBy("run_id").agg((F.max("year") - F.min("year")).alias("span"))
    return S.combined_staleness(own, other, spans)


def staleness_combined(spark, d):
    r = Run(spark, d)
    return staleness(r)


@once
def _stale_candidates(r):
    return S.stale_entities(staleness(r), entities(r))


def stale_candidates(spark, d):
    return _stale_candidates(Run(spark, d))


@once
def _candidate_staleness(r):
    """Each paper's core as a candidate whose newest statement is the paper."""
    t = on_topic(r)
    ref = t.groupBy("run_id").agg(F.max("year").alias("reference"))
    c = _cores(r).join(t.select("run_id", F.col("paper_id").alias("cluster"), F.col("year").alias("latest")), ["run_id", "cluster"]).join(ref, "run_id")
    c = c.select("run_id", F.col("cluster").alias("gap_id"), "core", "latest", "reference", F.when(F.size("core") > 3, 1).otherwise(0).alias("addressed"))
    return S.candidate_staleness(c, staleness(r)).select("run_id", "gap_id", "tau", "external")


def candidate_staleness(spark, d):
    return _candidate_staleness(Run(spark, d))


@once
def _topics(r):
    """A chunk belongs to the topics of its specific entities of type TASK."""
    m = on_topic_mentions(r).filter("entity like 'TASK:%'").join(entities(r).filter("specific").select("run_id", "entity"), ["run_id", "entity"], "left_semi")
    return m.select("run_id", F.col("entity").alias("topic"), "chunk_id").distinct()


def _chunks(r):
    return on_topic_mentions(r).groupBy("run_id", "chunk_id").agg(F.min("paper_id").alias("paper_id"))


def _vectors(r):
    v = table(r.spark, r.d, "chunk_embeddings").filter("embedding_model = 'lumen-base-192' and size(embedding) = 192 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('infinity'))")
    return v.groupBy("chunk_id").agg(F.max(F.struct("updated_at", "embedding"))["embedding"].alias("embedding"))


@once
def _profile(r, vectors=True):
    return S.topic_profile(_topics(r), _chunks(r), on_topic(r).select("run_id", "paper_id", "year"), _vectors(r) if vectors else None)


def topic_profiles(spark, d):
    r = Run(spark, d)
    return _profile(r)


@once
def _sparse_topic_candidates(r):
    return S.sparse_topics(_profile(r, False).withColumn("relevance", F.col("recent_share"))).select("run_id", "topic", "papers", "density")


def sparse_topic_candidates(spark, d):
    return _sparse_topic_candidates(Run(spark, d))


@once
def _topic_votes(r):
    evidence = _chunks(r).withColumnRenamed("paper_id", "gap_id")
    return S.topic_of(evidence, _topics(r), _profile(r, False))


def topic_votes(spark, d):
    return _topic_votes(Run(spark, d))


def topic_entities(spark, d):
    r = Run(spark, d)
    return S.top_entities(_topics(r), on_topic_mentions(r), entities(r))


def topic_terms(spark, d):
    return S.topic_terms(table(spark, d, "sections").dropDuplicates(["section_id"]), "section_type")


def concept_topics(spark, d):
    r = Run(spark, d)
    groups = G.communities(on_topic_edges(r), 1.3)
    t = S.concept_topics(groups, on_topic_mentions(r))
    return t.groupBy("run_id", "topic").agg(F.count("*").alias("chunks"))


def topic_centroids(spark, d):
    c = S.centroids(table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("d", "x")).select("label", "d", F.round("x", 5).alias("x"))


def detector_fusion(spark, d):
    """Papers' cores as stated candidates; rare pairs, stale entities and thin topics as guests."""
    r = Run(spark, d)
    m = _chunks(r)
    own = m.groupBy("run_id", F.col("paper_id").alias("cluster")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks"))
    hosts = _cores(r).join(own, ["run_id", "cluster"]).select("run_id", F.col("cluster").alias("gap_id"), F.col("cluster").alias("place"), "core", "chunks")
    none = F.array().cast("array<string>")
    pairs = on_topic_edges(r).filter("pmi < 0.2").select("run_id", F.concat_ws("~", "a", "b").alias("gap_id"), F.lit("combination_sparsity").alias("detector"), F.array("a", "b").alias("concepts"), none.alias("chunks"))
    stale = _stale_candidates(r).select("run_id", F.concat(F.lit("stale:"), "entity").alias("gap_id"), F.lit("temporal_staleness").alias("detector"), F.array("entity").alias("concepts"), none.alias("chunks"))
    t = _topics(r)
    thin = _sparse_topic_candidates(r).join(t.groupBy("run_id", "topic").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunks")), ["run_id", "topic"])
    thin = thin.select("run_id", F.concat(F.lit("topic:"), "topic").alias("gap_id"), F.lit("topic_density").alias("detector"), F.array("topic").alias("concepts"), "chunks")
    return S.fused(pairs.unionByName(stale).unionByName(thin), hosts).select("run_id", "gap_id", F.array_join("detectors", "+").alias("detectors"))


def _full(r):
    """Each paper's core scored by its own signals."""
    stated = _chunk_statements(r).groupBy("run_id", F.col("paper_id").alias("gap_id")).agg(F.sum(F.round(1 / (1 + F.size("entities")), 6)).alias("support"), F.count("*").alias("stating_papers"))
    tau = _candidate_staleness(r)
    topic = _topic_votes(r).join(_profile(r, False).select("run_id", "topic", "density", "novelty"), ["run_id", "topic"]).select("run_id", "gap_id", "density", "novelty")
    t = on_topic(r)
    spans = t.groupBy("run_id").agg((F.max("year") - F.min("year")).alias("span"), F.count("*").alias("on_topic_papers"))
    j = stated.join(tau.select("run_id", "gap_id", F.col("tau").alias("staleness"), "external"), ["run_id", "gap_id"], "left").join(topic, ["run_id", "gap_id"], "left").join(spans, "run_id")
    j = j.withColumn("sparsity_raw", F.coalesce(1 - F.col("density"), F.lit(0.0))).withColumn("detectors", F.when(F.col("staleness") >= 0.65, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return S.full_score(j)


def full_gap_score(spark, d):
    r = Run(spark, d)
    return _full(r).select("run_id", "gap_id", "gap_score", "baseline_score")


def baseline_ranks(spark, d):
    r = Run(spark, d)
    ranked = P.diversity_rank(_full(r).withColumn("kind", F.substring("gap_id", 3, 1)), "gap_score", "kind", "gap_id", by=["run_id"])
    return S.baseline_rank(ranked, ["run_id"]).select("run_id", "gap_id", "rank", "rank_score", "baseline_rank")


def gap_typing(spark, d):
    """Types of all documents as statements, a section's type standing for the concepts' and later work for the detector."""
    t = table(spark, d, "documents").filter("text is not null")
    kinds = F.when(F.col("section_type").isNotNull(), F.array("section_type")).otherwise(F.array().cast("array<string>"))
    detector = F.when(F.col("section_type") == "FUTURE_WORK", "temporal_staleness").otherwise("explicit_statements")
    return t.select(S.gap_type(F.col("text"), kinds, detector).alias("gap_type")).groupBy("gap_type").agg(F.count("*").alias("n"))


def gap_type_labels(spark, d):
    t = table(spark, d, "sections").select(F.concat(F.lit(" "), F.upper("section_type")).alias("label")).distinct()
    more = spark.createDataFrame([("Contradiction",), ("METHODOLOGY",), ("Contradictory Evidence ",), ("population",), ("unknown",), ("Method",), (None,)], "label string")
    return t.unionByName(more).select("label", S.gap_type_of_label(F.col("label")).alias("gap_type"))


def clean_statements(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select(S.clean_statement(F.col("text")).alias("s"), F.trim("text").alias("t"))
    return t.agg(F.sum((F.col("s") != F.col("t")).cast("int")).alias("changed"), F.count_distinct(F.substring("s", 1, 20)).alias("begins"), F.sum(F.length("s")).alias("characters"))


def citation_resolution(spark, d):
    """Chunk ids as a model might cite them, some of them unknown."""
    ids = table(spark, d, "chunk_embeddings").select("chunk_id").distinct()
    forms = F.array(F.col("chunk_id"), F.concat(F.lit("[chunk_id: "), "chunk_id", F.lit("]")), F.concat(F.lit(" `id="), "chunk_id", F.lit("` ")), F.concat(F.lit('"('), "chunk_id", F.lit(')"')), F.concat(F.lit("see "), "chunk_id"), F.upper("chunk_id"))
    return S.resolve_citations(ids.select(F.explode(forms).alias("cited")), ids).groupBy(F.length("cited").alias("size")).agg(F.count("*").alias("n"))


def candidate_base_scores(spark, d):
    e = newest(table(spark, d, "kg_edges").distinct(), ["run_id", "a", "b"], "built_at")
    evidence = F.when(F.col("papers") > 4, F.col("papers") / 10.0)
    return e.select("run_id", "a", "b", F.round(S.base_score(F.col("pmi") / 5, F.col("papers"), F.col("papers") * 2, evidence), 6).alias("score"))


def validation_batch(spark, d):
    """The candidates of each run that are validated first, one in four of them proposed by a model."""
    e = newest(table(spark, d, "kg_edges").distinct(), ["run_id", "a", "b"], "built_at").withColumn("gap_id", F.concat_ws("~", "a", "b"))
    e = e.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("papers"), "gap_id"))).withColumn("source", F.when(F.length("gap_id") % 4 == 0, "llm").otherwise("signal"))
    return S.interleaved(e.select("run_id", "gap_id", "source", "rank")).select("run_id", "gap_id", "source", "place")


def tk(x: str) -> str:
    k = rf"trim(regexp_replace(lower({x}), '[-_\s]+', ' ', 'g'))"
    return f"CASE WHEN length({k}) > 4 AND ends_with({k}, 's') AND NOT ends_with({k}, 'ss') THEN left({k}, -1) ELSE {k} END"


BASE = (
    graph.BASE
    + f""", ot AS (SELECT run_id, paper_id, title, CASE WHEN publication_year > 0 THEN publication_year END AS year, relevance FROM kp WHERE on_topic), nt AS (SELECT run_id, count(*) AS n FROM ot GROUP BY run_id),
nmt AS (SELECT nm.* FROM nm JOIN ot USING (run_id, paper_id)), ept AS (SELECT ep.* FROM ep JOIN ot USING (run_id, paper_id)), ft AS (SELECT run_id, entity, count(*) AS f FROM ept GROUP BY ALL),
prt AS (SELECT a.run_id, a.entity AS a, b.entity AS b, count(*) AS papers FROM ept a JOIN ept b ON a.run_id = b.run_id AND a.paper_id = b.paper_id AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2),
edt AS (SELECT prt.run_id, a, b, papers, round(log2(papers * n / (fa.f * fb.f)::DOUBLE), 4) AS pmi FROM prt JOIN nt USING (run_id) JOIN ft fa ON fa.run_id = prt.run_id AND fa.entity = a JOIN ft fb ON fb.run_id = prt.run_id AND fb.entity = b),
qs AS (SELECT run_id, {tk("coalesce(m.t, '')")} AS asked FROM (SELECT run_id, max(struct_pack(r := coalesce(relevance, -1), p := paper_id, t := title)) AS m FROM ot GROUP BY run_id)),
al AS (SELECT upper(trim(entity_type)) || ':' || {tk("name")} AS entity, flatten(list(coalesce(aliases, []))) AS aliases FROM kg_entities GROUP BY 1),
fg AS (SELECT ft.run_id, ft.entity, f AS papers, f >= 0.8 * n AND n >= 5 AS generic, contains(asked, {tk("ft.entity[strpos(ft.entity, ':') + 1:]")}) OR len(list_filter(coalesce(aliases, []), lambda x: length(x) > 3 AND contains(asked, {tk("x")}))) > 0 AS query_term
 FROM ft JOIN nt USING (run_id) JOIN qs USING (run_id) LEFT JOIN al USING (entity)),
fl AS (SELECT *, NOT generic AND NOT query_term AS specific FROM fg),
cs AS (SELECT run_id, chunk_id AS s, paper_id, list_sort(list(DISTINCT entity)) AS es FROM nmt GROUP BY ALL)"""
)
CORE_SQL = """, ce AS (SELECT run_id, paper_id AS cl, s, unnest(es) AS entity FROM cs), cn AS (SELECT run_id, paper_id AS cl, count(DISTINCT s) AS n FROM cs GROUP BY ALL),
cc AS (SELECT ce.run_id, cl, ce.entity, fl.papers, count(DISTINCT s) AS c FROM ce JOIN fl ON fl.run_id = ce.run_id AND fl.entity = ce.entity AND fl.specific GROUP BY ALL),
cf AS (SELECT cc.*, c >= CASE WHEN n > 1 THEN ceil(n * 0.5) ELSE 1 END AS shared FROM cc JOIN cn USING (run_id, cl)), cg AS (SELECT *, bool_or(shared) OVER (PARTITION BY run_id, cl) AS any_ FROM cf),
cr AS (SELECT *, row_number() OVER (PARTITION BY run_id, cl ORDER BY c DESC, papers DESC, entity) AS r FROM cg WHERE shared OR NOT any_),
co AS (SELECT run_id, cl, list(entity ORDER BY r) AS core FROM cr WHERE r <= 4 GROUP BY ALL)"""
STALE_SQL = """, ty AS (SELECT run_id, year, count(*) AS total FROM ot WHERE year IS NOT NULL GROUP BY ALL), ey AS (SELECT run_id, entity, year, count(*) AS papers FROM ept JOIN ot USING (run_id, paper_id) WHERE year IS NOT NULL GROUP BY ALL),
rf AS (SELECT run_id, max(year) AS ref, max(year) - min(year) AS span FROM ty GROUP BY run_id), la AS (SELECT run_id, entity, max(year) AS last_year FROM ey GROUP BY ALL),
gr AS (SELECT la.run_id, la.entity, last_year, ref, ty.year, coalesce(ey.papers, 0) / total::DOUBLE AS share FROM la JOIN rf USING (run_id) JOIN ty ON ty.run_id = la.run_id AND ty.year > ref - 5 LEFT JOIN ey ON ey.run_id = la.run_id AND ey.entity = la.entity AND ey.year = ty.year),
iz AS (SELECT run_id, entity, max(last_year) AS l, max(ref) AS ref, coalesce(regr_slope(share, year::DOUBLE), 0) AS slope FROM gr GROUP BY ALL), own AS (SELECT run_id, entity, round(0.6 * least(1.0, (ref - l) / 5.0) + 0.4 / (1 + exp(20 * slope)), 4)::DOUBLE AS tau FROM iz),
fy AS (SELECT year, sum(total) AS field FROM ty GROUP BY year), wy AS (SELECT entity, year, sum(papers) AS papers FROM ey GROUP BY ALL),
xg AS (SELECT e.entity, fy.year, field, coalesce(wy.papers, 0) AS papers, coalesce(wy.papers, 0) / field::DOUBLE AS share, row_number() OVER (PARTITION BY e.entity ORDER BY fy.year DESC) AS k FROM (SELECT DISTINCT entity FROM ey) e CROSS JOIN fy LEFT JOIN wy ON wy.entity = e.entity AND wy.year = fy.year WHERE fy.year < 2025 AND fy.year >= 2019),
xa AS (SELECT entity, count(*) AS n, avg(share) AS share, regr_slope(share, year::DOUBLE) AS slope, sum(CASE WHEN k <= 2 THEN papers ELSE 0 END) AS r FROM xg GROUP BY entity HAVING count(*) >= 3),
ext AS (SELECT h.run_id, entity, round(CASE WHEN share <= 0 OR r = 0 THEN 1 ELSE 1 / (1 + exp(8 * slope / share)) END, 4)::DOUBLE AS tau FROM xa JOIN (SELECT run_id, entity FROM ey GROUP BY ALL HAVING sum(papers) >= 4) h USING (entity)),
sj AS (SELECT run_id, entity, own.tau AS a, ext.tau AS b, 0.5 * least(1.0, coalesce(span, 0) / 4.0) AS w FROM own FULL JOIN ext USING (run_id, entity) LEFT JOIN rf USING (run_id)),
stl AS (SELECT run_id, entity, round((coalesce(w * a, 0) + coalesce(b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE w END + CASE WHEN b IS NULL THEN 0 ELSE 1 END, 0), 4)::DOUBLE AS tau, b IS NOT NULL AS external FROM sj),
sc AS (SELECT stl.run_id, stl.entity, papers, tau FROM stl JOIN fl ON fl.run_id = stl.run_id AND fl.entity = stl.entity AND specific WHERE papers >= 3 AND tau >= 0.65 AND split_part(stl.entity, ':', 1) IN ('METHOD', 'DATASET', 'MODALITY', 'TASK', 'DISEASE', 'CONCEPT', 'POPULATION'))"""
CAND_SQL = """, cm AS (SELECT co.run_id, cl AS gap_id, core, ot.year AS latest, mx.reference, CASE WHEN len(core) > 3 THEN 1 ELSE 0 END AS addressed FROM co JOIN ot ON ot.run_id = co.run_id AND ot.paper_id = cl JOIN (SELECT run_id, max(year) AS reference FROM ot GROUP BY run_id) mx ON mx.run_id = co.run_id),
cx AS (SELECT cm.run_id, gap_id, avg(tau) AS m, bool_or(external AND tau IS NOT NULL) AS external FROM (SELECT run_id, gap_id, unnest(core) AS entity FROM cm) cm JOIN stl USING (run_id, entity) GROUP BY ALL),
ct AS (SELECT cm.run_id, cm.gap_id, round(CASE WHEN reference - latest >= 3 AND addressed = 0 THEN greatest(coalesce(m, 0), 0.8) ELSE m END + 1e-9, 4)::DOUBLE AS tau, coalesce(external, false) AS external FROM cm LEFT JOIN cx USING (run_id, gap_id))"""
TOPIC_SQL = """, tp AS (SELECT DISTINCT nmt.run_id, nmt.entity AS topic, chunk_id FROM nmt JOIN fl ON fl.run_id = nmt.run_id AND fl.entity = nmt.entity AND specific WHERE starts_with(nmt.entity, 'TASK:')), ck AS (SELECT run_id, chunk_id, min(paper_id) AS paper_id FROM nmt GROUP BY ALL),
tj AS (SELECT tp.*, paper_id FROM tp JOIN ck USING (run_id, chunk_id)), yr AS (SELECT run_id, max(year) AS ref FROM ot GROUP BY run_id),
tt AS (SELECT run_id, topic, count(*) AS papers, sum(CASE WHEN year >= ref - 1 THEN 1 ELSE 0 END) AS recent FROM (SELECT DISTINCT run_id, topic, paper_id FROM tj) x LEFT JOIN ot USING (run_id, paper_id) LEFT JOIN yr USING (run_id) GROUP BY ALL),
tm AS (SELECT run_id, coalesce(median(papers) FILTER (papers >= 2), median(papers)) AS middle FROM tt GROUP BY run_id), tc AS (SELECT run_id, topic, count(*) AS chunks FROM tj GROUP BY ALL),
td AS (SELECT run_id, topic, chunks, papers, round(least(1.0, papers / middle), 4)::DOUBLE AS density, recent / papers::DOUBLE AS rs, papers >= middle AS large FROM tt JOIN tm USING (run_id) JOIN tc USING (run_id, topic))"""
VOTE_SQL = """, t1 AS (SELECT tp.run_id, chunk_id, arg_min(topic, struct_pack(p := papers, t := topic)) AS topic FROM tp JOIN td USING (run_id, topic) GROUP BY ALL), tv AS (SELECT ck.run_id, ck.paper_id AS gap_id, topic, count(*) AS v FROM ck JOIN t1 USING (run_id, chunk_id) GROUP BY ALL),
tw AS (SELECT run_id, gap_id, arg_min(topic, struct_pack(v := -v, t := topic)) AS topic FROM tv GROUP BY ALL)"""
FULL_SQL = """, su AS (SELECT run_id, paper_id AS gap_id, sum(round(1 / (1 + len(es))::DOUBLE, 6)) AS support, count(*) AS sp FROM cs GROUP BY ALL), sn AS (SELECT run_id, max(year) - min(year) AS span, count(*) AS n_on FROM ot GROUP BY run_id),
fj AS (SELECT su.*, ct.tau AS st, coalesce(ct.external, false) AS ex, td.density, CASE WHEN td.density IS NULL THEN NULL ELSE round(0.5 + 0.5 * rs, 4)::DOUBLE END AS nov, coalesce(span, 0) AS span, n_on FROM su LEFT JOIN ct USING (run_id, gap_id) LEFT JOIN tw USING (run_id, gap_id) LEFT JOIN td USING (run_id, topic) JOIN sn USING (run_id)),
fk AS (SELECT *, CASE WHEN support > 0 THEN 1 - exp(-support / 2) ELSE 0 END AS e, coalesce(1 - density, 0) AS raw, coalesce(1 - density, 0) * least(1.0, n_on / 50.0) AS s, least(sp / 3.0, 1.0) AS i, CASE WHEN st >= 0.65 THEN 1 / 3.0 ELSE 0 END AS ag, CASE WHEN st IS NULL THEN 0 WHEN NOT ex AND span < 4 THEN 0.075 ELSE 0.15 END AS wt, CASE WHEN nov IS NULL THEN 0 ELSE 0.1 END AS wn FROM fj),
fs AS (SELECT run_id, gap_id, round(least(1.0, (e * 0.25 + s * 0.25 + coalesce(st, 0) * wt + coalesce(nov, 0) * wn + i * 0.15) / (0.65 + wt + wn) + 0.1 * ag) + 1e-9, 4)::DOUBLE AS gap_score, round(0.45 * raw + 0.35 * coalesce(st, 0) + 0.2 * coalesce(nov, 0) + 1e-9, 4)::DOUBLE AS baseline_score FROM fk)"""


_CLEAN = f"list_reduce(list_prepend(trim(text, ' '), [{', '.join(repr(c) for c in S.CONNECTIVES)}]), lambda v, c: CASE WHEN starts_with(v, c) THEN upper(v[length(c) + 1]) || v[length(c) + 2:] ELSE v END)"


QUERIES = {
    f.__name__: f
    for f in (
        entity_flags, specific_statements, core_entities, field_anchors, staleness_combined, stale_candidates, candidate_staleness, topic_profiles, sparse_topic_candidates, topic_votes, topic_entities, topic_terms, concept_topics,
        topic_centroids, detector_fusion, full_gap_score, baseline_ranks, gap_typing, gap_type_labels, clean_statements, citation_resolution, candidate_base_scores, validation_batch,
    )
}
_STOP = ", ".join(f"'{w}'" for w in S.TOPIC_STOP)
_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ({t.lower(): t for t in S.GAP_TYPES} | S.GAP_ALIASES).items())
_E = "(SELECT run_id, a, b, max(struct_pack(t := built_at, p := papers, i := pmi)) AS r FROM (SELECT DISTINCT * FROM kg_edges) GROUP BY run_id, a, b)"
ORACLES = {
    "entity_flags": BASE + " SELECT * FROM fl",
    "specific_statements": BASE + " SELECT run_id, count(*) AS statements, count(DISTINCT paper_id) AS papers FROM cs WHERE EXISTS (SELECT 1 FROM fl WHERE fl.run_id = cs.run_id AND specific AND list_contains(cs.es, fl.entity)) GROUP BY run_id",
    "core_entities": BASE + CORE_SQL + " SELECT run_id, cl AS paper_id, array_to_string(core, ' | ') AS core FROM co",
    "field_anchors": BASE + """, x AS (SELECT run_id, regexp_replace(entity, '^(TASK|METHOD):', 'CONCEPT:') AS entity, papers FROM fl WHERE papers >= 3), y AS (SELECT *, split_part(entity, ':', 1) AS kind, entity[strpos(entity, ':') + 1:] AS name FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind IN ('DISEASE', 'MODALITY') DESC, papers DESC, entity) AS r FROM y WHERE kind IN ('DISEASE', 'MODALITY', 'CONCEPT') AND name NOT IN ('machine learning', 'deep learning', 'computer vision', 'artificial intelligence', 'image analysis', 'image processing', 'neural network', 'disease detection', 'detection', 'classification'))
SELECT run_id, coalesce(list_filter(string_split(name, ' '), lambda w: length(w) > 3)[1], name) AS anchor FROM z WHERE r = 1""",
    "staleness_combined": BASE + STALE_SQL + " SELECT run_id, entity, tau, external FROM stl",
    "stale_candidates": BASE + STALE_SQL + " SELECT * FROM sc",
    "candidate_staleness": BASE + CORE_SQL + STALE_SQL + CAND_SQL + " SELECT * FROM ct",
    "topic_profiles": BASE + TOPIC_SQL + """, v AS (SELECT chunk_id, max(struct_pack(t := updated_at, e := embedding)).e AS e FROM chunk_embeddings WHERE embedding_model = 'lumen-base-192' AND len(embedding) = 192 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY chunk_id),
vu AS (SELECT run_id, topic, generate_subscripts(e, 1) AS d, unnest(e)::DOUBLE / CASE WHEN list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) ELSE 1 END AS x FROM tp JOIN v USING (chunk_id)),
vm AS (SELECT run_id, topic, d, avg(x) AS m FROM vu GROUP BY ALL), vn AS (SELECT run_id, topic, sqrt(sum(m * m)) + 1e-12 AS n FROM vm GROUP BY ALL),
vp AS (SELECT a.run_id, a.topic, max(s) AS ms FROM (SELECT a.run_id, a.topic, b.topic AS other, sum(a.m * b.m) / (min(na.n) * min(nb.n)) AS s FROM vm a JOIN vm b ON a.run_id = b.run_id AND a.d = b.d AND a.topic <> b.topic JOIN td tb ON tb.run_id = b.run_id AND tb.topic = b.topic AND tb.large
 JOIN vn na ON na.run_id = a.run_id AND na.topic = a.topic JOIN vn nb ON nb.run_id = b.run_id AND nb.topic = b.topic GROUP BY ALL) a GROUP BY ALL),
vq AS (SELECT td.*, coalesce(ms, 0) AS ms, vn.n IS NOT NULL AS known FROM td LEFT JOIN vp USING (run_id, topic) LEFT JOIN vn USING (run_id, topic))
SELECT run_id, topic, chunks, papers, density, round(rs, 4) AS recent_share, round(ms, 4) AS max_similarity, round(0.5 * least(1.0, greatest(0.0, CASE WHEN known THEN 1 - ms ELSE 1 END / 0.3)) + 0.5 * rs, 4) AS novelty FROM vq""",
    "sparse_topic_candidates": BASE + TOPIC_SQL + """, g AS (SELECT run_id, list_sort(list(round(rs, 4)))[count(*) // 2 + 1] - 0.05 AS gate FROM td GROUP BY run_id) SELECT run_id, topic, papers, density FROM td JOIN g USING (run_id) WHERE density <= 0.35 AND papers >= 2 AND round(rs, 4) >= gate""",
    "topic_votes": BASE + TOPIC_SQL + VOTE_SQL + " SELECT * FROM tw",
    "topic_entities": BASE + TOPIC_SQL + """, c AS (SELECT tp.run_id, topic, m.entity, count(*) AS c FROM tp JOIN (SELECT DISTINCT run_id, chunk_id, entity FROM nmt) m USING (run_id, chunk_id) JOIN fl ON fl.run_id = tp.run_id AND fl.entity = m.entity AND specific GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY c DESC, entity) AS r FROM c) SELECT run_id, topic, r, entity FROM r WHERE r <= 4""",
    "topic_terms": rf"""WITH s AS (SELECT DISTINCT ON (section_id) section_id, section_type, text FROM sections), q AS (SELECT * FROM s WHERE text IS NOT NULL AND section_type IS NOT NULL),
c AS (SELECT section_type, term, count(*) AS c FROM (SELECT section_type, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\-]{{3,}}'), lambda w: w NOT IN ({_STOP})))) AS term FROM q) GROUP BY ALL),
z AS (SELECT section_type, term, round(c * ln(1 + (SELECT count(DISTINCT section_type) FROM q) / count(*) OVER (PARTITION BY term)::DOUBLE), 9) AS s FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY section_type ORDER BY s DESC, term) AS r FROM z) SELECT section_type, r, term FROM r WHERE r <= 5""",
    "topic_centroids": """WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM u GROUP BY ALL)
SELECT label, d, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 5) AS x FROM m""",
    "detector_fusion": BASE + CORE_SQL + STALE_SQL + TOPIC_SQL + """, gate AS (SELECT run_id, list_sort(list(round(rs, 4)))[count(*) // 2 + 1] - 0.05 AS gate FROM td GROUP BY run_id), thin AS (SELECT run_id, topic FROM td JOIN gate USING (run_id) WHERE density <= 0.35 AND papers >= 2 AND round(rs, 4) >= gate),
ho AS (SELECT co.run_id, cl AS host, core, list(DISTINCT chunk_id) AS own FROM co JOIN ck ON ck.run_id = co.run_id AND ck.paper_id = cl GROUP BY ALL),
gu AS (SELECT run_id, a || '~' || b AS gap_id, 'combination_sparsity' AS det, [a, b] AS cs_, []::VARCHAR[] AS ch FROM edt WHERE pmi < 0.2 UNION ALL SELECT run_id, 'stale:' || entity, 'temporal_staleness', [entity], [] FROM sc
 UNION ALL SELECT run_id, 'topic:' || topic, 'topic_density', [topic], list(DISTINCT chunk_id) FROM thin JOIN tp USING (run_id, topic) GROUP BY run_id, topic),
pp AS (SELECT gu.run_id, gap_id, det, host, cs_, ch, core, own, len(list_intersect(cs_, core)) AS i FROM gu JOIN ho USING (run_id)),
mt AS (SELECT run_id, gap_id, det, min(host) AS host FROM pp WHERE CASE det WHEN 'combination_sparsity' THEN i = len(cs_) OR (len(core) >= 2 AND i / (len(cs_) + len(core) - i)::DOUBLE >= 0.6) WHEN 'temporal_staleness' THEN list_contains(cs_, core[1])
 ELSE len(list_intersect(ch, own)) >= 2 OR i / (len(cs_) + len(core) - i)::DOUBLE >= 0.5 END GROUP BY ALL),
jn AS (SELECT run_id, host, list_sort(list(DISTINCT det)) AS more FROM mt GROUP BY ALL)
SELECT ho.run_id, ho.host AS gap_id, array_to_string(list_concat(['explicit_statements'], coalesce(more, [])), '+') AS detectors FROM ho LEFT JOIN jn USING (run_id, host) UNION ALL SELECT run_id, gap_id, det FROM gu WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.run_id = gu.run_id AND mt.gap_id = gu.gap_id)""",
    "full_gap_score": BASE + CORE_SQL + STALE_SQL + CAND_SQL + TOPIC_SQL + VOTE_SQL + FULL_SQL + " SELECT * FROM fs",
    "baseline_ranks": BASE + CORE_SQL + STALE_SQL + CAND_SQL + TOPIC_SQL + VOTE_SQL + FULL_SQL + """, j AS (SELECT *, round(gap_score - 0.05 * least(row_number() OVER (PARTITION BY run_id, gap_id[3] ORDER BY gap_score DESC, gap_id DESC) - 1, 2), 6) AS rank_score FROM fs),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank_score DESC, gap_score DESC, gap_id DESC) AS rank FROM j) SELECT run_id, gap_id, rank, rank_score, row_number() OVER (PARTITION BY run_id ORDER BY baseline_score DESC, rank) AS baseline_rank FROM r""",
    "gap_typing": f"""SELECT CASE WHEN section_type IS NOT DISTINCT FROM 'FUTURE_WORK' THEN 'Temporal' WHEN regexp_matches(text, '{S.CONTRADICTION}') THEN 'Contradictory Evidence' WHEN section_type IS NOT DISTINCT FROM 'POPULATION' OR regexp_matches(text, '{S.POPULATION}') THEN 'Population'
 WHEN section_type IS NOT DISTINCT FROM 'DATASET' OR regexp_matches(text, '{S.DATASET}') THEN 'Dataset' WHEN section_type IS NOT DISTINCT FROM 'METRIC' OR regexp_matches(text, '{S.EVALUATION}') THEN 'Evaluation' ELSE 'Methodological' END AS gap_type, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "gap_type_labels": f"""WITH l AS (SELECT DISTINCT ' ' || upper(section_type) AS label FROM sections UNION ALL SELECT * FROM (VALUES ('Contradiction'), ('METHODOLOGY'), ('Contradictory Evidence '), ('population'), ('unknown'), ('Method'), (NULL)) v(label)) SELECT label, CASE lower(trim(label)) {_ALIASES} END AS gap_type FROM l""",
    "clean_statements": f"WITH t AS (SELECT {_CLEAN} AS s, trim(text, ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT sum((s <> t)::INT)::BIGINT AS changed, count(DISTINCT left(s, 20)) AS begins, sum(length(s))::BIGINT AS characters FROM t",
    "citation_resolution": "WITH i AS (SELECT DISTINCT chunk_id FROM chunk_embeddings) SELECT size::INT AS size, count(*) AS n FROM (SELECT length(chunk_id) + unnest([0, 12, 7, 4]) AS size FROM i) GROUP BY 1",
    "candidate_base_scores": f"""WITH e AS {_E}, x AS (SELECT run_id, a, b, 0.6 * coalesce(least(greatest(r.i / 5, 0), 1), 0) + 0.25 * least(r.p / 3.0, 1) + 0.15 * least(r.p * 2 / 5.0, 1) AS o, CASE WHEN r.p > 4 THEN least(r.p / 10.0, 1) END AS v FROM e) SELECT run_id, a, b, round(CASE WHEN v IS NULL THEN o ELSE 0.5 * o + 0.5 * v END, 6) AS score FROM x""",
    "validation_batch": f"""WITH e AS {_E}, x AS (SELECT run_id, a || '~' || b AS gap_id, row_number() OVER (PARTITION BY run_id ORDER BY r.p DESC, a || '~' || b) AS k, CASE WHEN length(a || '~' || b) % 4 = 0 THEN 'llm' ELSE 'signal' END AS source FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY k) AS t FROM x), p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, source = 'llm') AS place FROM t) SELECT run_id, gap_id, source, place FROM p WHERE place <= 10""",
}

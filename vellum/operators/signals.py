"""Signals of gaps on a run's knowledge graph: specific statements, trends, topics, fusion of detectors and the full score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scores import sigmoid, weighted_mean
from vellum.functions.text import jaccard, term_key
from vellum.operators.gaps import GAP_WEIGHTS

# Beginnings of sentences that say nothing by themselves.
CONNECTIVES = ["However, ", "Furthermore, ", "Moreover, ", "In addition, ", "Additionally, ", "Also, ", "Nevertheless, ", "Still, ", "Unfortunately, ", "Notably, ", "Overall, "]
# Patterns of gap types, in order, and labels that mean a type.
CONTRADICTION = r"(?i)\b(contradict|conflict|inconsistent|disagree)"
POPULATION = r"(?i)\b(population|ethnic|demographic|children|paediatric|pediatric|elderly|rural|low-resource|underserved|countr|region|geograph)"
DATASET = r"(?i)\b(dataset|data set|labell?ed data|annotat|benchmark data|data scarcity|small data|data imbalance|class imbalance)"
EVALUATION = r"(?i)\b(evaluat|validat|benchmark|metric|external test|comparison|compared)"
GAP_TYPES = ["Methodological", "Dataset", "Evaluation", "Population", "Temporal", "Contradictory Evidence", "Other"]
GAP_ALIASES = {"contradictory_evidence": "Contradictory Evidence", "contradictory": "Contradictory Evidence", "contradiction": "Contradictory Evidence", "methodology": "Methodological", "method": "Methodological", "data": "Dataset", "unknown": "Other"}
# Types whose trends count, words that name no field, thresholds, and weights of the baseline score.
TREND_TYPES = ["METHOD", "DATASET", "MODALITY", "TASK", "DISEASE", "CONCEPT", "POPULATION"]
FIELD_TYPES = ["DISEASE", "MODALITY", "CONCEPT"]
NO_FIELD = ["machine learning", "deep learning", "computer vision", "artificial intelligence", "image analysis", "image processing", "neural network", "disease detection", "detection", "classification"]
STALE, SPARSE_TOPIC, SMALL_CORPUS, SATURATION = 0.65, 0.35, 50, 3
BASELINE = {"sparsity": 0.45, "staleness": 0.35, "novelty": 0.20}
# Words that tell nothing of a topic.
TOPIC_STOP = (
    "the and for with that this from are were was have has been into their which these those using used based also than more most such other between within while where when they them both each over under "
    "about after before during among across through results result study studies paper papers model models method methods data images image proposed approach approaches performance accuracy table figure shown show shows however"
).split()


def clean_statement(sentence: Column) -> Column:
    """A sentence without leading connectives, each taken once in their order, beginning with a capital again."""
    rest = lambda s, c: F.substr(s, F.length(c) + 1)
    bare = lambda s, c: F.when(F.startswith(s, c), F.concat(F.upper(F.substr(rest(s, c), F.lit(1), F.lit(1))), F.substr(rest(s, c), F.lit(2)))).otherwise(s)
    return F.aggregate(F.array(*map(F.lit, CONNECTIVES)), F.trim(sentence), bare)


def gap_type(statement: Column, types: Column, detector: Column) -> Column:
    """Type of a gap by the first rule that holds; ``types``: array of its concepts' types, ``detector``: the one that found it first."""
    return (
        F.when(detector == "temporal_staleness", "Temporal").when(statement.rlike(CONTRADICTION), "Contradictory Evidence").when(F.array_contains(types, "POPULATION") | statement.rlike(POPULATION), "Population")
        .when(F.array_contains(types, "DATASET") | statement.rlike(DATASET), "Dataset").when(F.array_contains(types, "METRIC") | statement.rlike(EVALUATION), "Evaluation").otherwise("Methodological")
    )


def gap_type_of_label(label: Column) -> Column:
    """The gap type that a label means, whatever its case; null for an unknown one."""
    key = F.lower(F.trim(label))
    known = {t.lower(): t for t in GAP_TYPES} | GAP_ALIASES
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)


def resolved_citation(cited: Column) -> Column:
    """A cited chunk id without brackets, quotes and labels around it, up to three layers; whether it is one is for a join to tell."""
    s = F.trim(cited)
    for _ in range(3):
        s = F.trim(F.regexp_replace(s, r"^[\[\](){}<>\"'`]+|[\[\](){}<>\"'`]+$", ""))
        s = F.trim(F.regexp_replace(s, r"(?i)^(?:chunk[\s_-]?id|id)\s*[:=]\s*", ""))
    return s


def resolve_citations(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(cited, chunk_id) of citations that name a supplied chunk, as written or undecorated; others have no row."""
    ids = chunks.select("chunk_id").distinct()
    c = cited.select("cited").distinct()
    exact = c.join(ids, c.cited == ids.chunk_id).select("cited", "chunk_id")
    rest = c.join(exact.select("cited"), "cited", "left_anti").withColumn("bare", resolved_citation(F.col("cited")))
    return exact.unionByName(rest.join(ids, F.col("bare") == F.col("chunk_id")).select("cited", "chunk_id"))


def flagged_entities(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds ``query_term``: the entity's name, or an alias of more than three characters, stands in the run's question; ``specific``: neither that nor generic.

    ``entities``: (run_id, entity "TYPE:name", aliases, generic); ``questions``: (run_id, question), one row per run.
    """
    asked = term_key(F.coalesce("question", F.lit("")))
    j = entities.join(questions, "run_id", "left").withColumn("asked", asked)
    name = term_key(F.element_at(F.split("entity", ":", 2), 2))
    known = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.length(a) > 3)
    hit = F.contains(F.col("asked"), name) | F.exists(known, lambda a: F.contains(F.col("asked"), term_key(a)))
    j = j.withColumn("query_term", F.coalesce(hit, F.lit(False)))
    return j.withColumn("specific", ~F.col("query_term") & ~F.col("generic")).drop("asked", "question")


def specific_statements(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Statements (run_id, statement_id, entities, ..) that name an entity which is neither generic nor part of the question."""
    named = statements.select("run_id", "statement_id", F.explode("entities").alias("entity")).join(entities.filter("specific").select("run_id", "entity"), ["run_id", "entity"], "left_semi")
    return statements.join(named.select("run_id", "statement_id").distinct(), ["run_id", "statement_id"], "left_semi")


def core_entities(members: DataFrame, entities: DataFrame, limit: int = 4) -> DataFrame:
    """(run_id, cluster, core): the specific entities that at least half of a cluster's statements name, else any; most frequent first.

    ``members``: (run_id, cluster, statement_id, entities); ``entities``: (run_id, entity, papers, specific).
    """
    size = members.groupBy("run_id", "cluster").agg(F.count_distinct("statement_id").alias("n"))
    each = members.select("run_id", "cluster", "statement_id", F.explode("entities").alias("entity")).distinct()
    c = each.join(entities.filter("specific").select("run_id", "entity", "papers"), ["run_id", "entity"]).groupBy("run_id", "cluster", "entity", "papers").agg(F.count("*").alias("c"))
    c = c.join(size, ["run_id", "cluster"]).withColumn("shared", F.col("c") >= F.when(F.col("n") > 1, F.ceil(F.col("n") * 0.5)).otherwise(1))
    w = Window.partitionBy("run_id", "cluster")
    c = c.withColumn("some", F.max("shared").over(w)).filter("shared or not some")
    c = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("c"), F.desc("papers"), "entity"))).filter(F.col("r") <= limit)
    return c.groupBy("run_id", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "entity"))), lambda x: x["entity"]).alias("core"))


def field_anchor(entities: DataFrame) -> DataFrame:
    """(run_id, anchor): the first word of more than three letters of the question's most frequent field term, diseases and modalities first."""
    kind, name = F.element_at(F.split("entity", ":", 2), 1), F.element_at(F.split("entity", ":", 2), 2)
    t = entities.filter("query_term").withColumn("kind", kind).withColumn("name", name).filter(F.col("kind").isin(FIELD_TYPES) & ~F.lower("name").isin(NO_FIELD))
    w = Window.partitionBy("run_id").orderBy(F.desc(F.col("kind").isin("DISEASE", "MODALITY")), F.desc("papers"), "entity")
    one = t.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return one.select("run_id", F.coalesce(F.get(F.filter(F.split("name", " "), lambda x: F.length(x) > 3), F.lit(0)), "name").alias("anchor"))


def combined_staleness(internal: DataFrame, external: DataFrame, spans: DataFrame) -> DataFrame:
    """(run_id, entity, tau, external): internal trends weigh half a year's span of four, external ones, where known, one.

    ``internal``, ``external``: (run_id, entity, tau); ``spans``: (run_id, span) in years. Null without either.
    """
    j = internal.select("run_id", "entity", F.col("tau").alias("own")).join(external.select("run_id", "entity", F.col("tau").alias("other")), ["run_id", "entity"], "full_outer").join(spans, "run_id", "left")
    w = 0.5 * F.least(F.lit(1.0), F.coalesce("span", F.lit(0)) / 4)
    weights = F.when(F.col("own").isNotNull(), w).otherwise(0.0) + F.when(F.col("other").isNotNull(), 1.0).otherwise(0.0)
    tau = (F.coalesce(w * F.col("own"), F.lit(0.0)) + F.coalesce("other", F.lit(0.0))) / F.nullif(weights, F.lit(0.0))
    return j.select("run_id", "entity", F.round(tau, 4).alias("tau"), F.col("other").isNotNull().alias("external"))


def stale_entities(staleness: DataFrame, entities: DataFrame, least_papers: int = 3) -> DataFrame:
    """(run_id, entity, papers, tau) of specific entities of trending types that are stale enough to be a candidate."""
    kind = F.element_at(F.split("entity", ":", 2), 1)
    return staleness.join(entities.filter("specific").select("run_id", "entity", "papers"), ["run_id", "entity"]).filter((F.col("papers") >= least_papers) & (F.col("tau") >= STALE) & kind.isin(TREND_TYPES)).select("run_id", "entity", "papers", "tau")


def candidate_staleness(candidates: DataFrame, staleness: DataFrame) -> DataFrame:
    """Adds ``tau`` and ``external``: the mean of the core's known taus; 0.8 at least where the newest statement is three years old and nobody followed up.

    ``candidates``: (run_id, gap_id, core, latest, reference, addressed); null years tell nothing.
    """
    each = candidates.select("run_id", "gap_id", F.explode("core").alias("entity")).join(staleness, ["run_id", "entity"])
    mean = each.groupBy("run_id", "gap_id").agg(F.avg("tau").alias("mean"), F.max(F.col("external") & F.col("tau").isNotNull()).alias("external"))
    j = candidates.join(mean, ["run_id", "gap_id"], "left")
    old = F.coalesce((F.col("reference") - F.col("latest") >= 3) & (F.coalesce("addressed", F.lit(0)) == 0), F.lit(False))
    tau = F.when(old, F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(0.8))).otherwise(F.col("mean"))
    return j.withColumn("tau", F.round(tau + 1e-9, 4)).withColumn("external", F.coalesce("external", F.lit(False))).drop("mean")


def centroids(members: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """(by, centroid): means of unit vectors, scaled to unit length; partial sums by dimension, so a large group reaches no task whole."""
    unit = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dims = members.filter(F.col(vector).isNotNull()).withColumn("norm", unit).select(*by, F.posexplode(vector).alias("d", "x"), "norm")
    mean = dims.groupBy(*by, "d").agg(F.avg(F.col("x").cast("double") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("m"))
    one = mean.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return one.select(*by, F.transform("c", lambda x: x / (F.col("norm") + 1e-12)).alias("centroid"))


def topic_terms(chunks: DataFrame, topic: str, text: str = "text", k: int = 5) -> DataFrame:
    """(topic, r, term): the ``k`` words of each topic of the greatest share of chunks, weighted by how few topics have them."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0)), lambda w: ~w.isin(TOPIC_STOP)))
    c = chunks.filter(F.col(text).isNotNull() & F.col(topic).isNotNull()).select(topic, F.explode(words).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("c"))
    groups = chunks.filter(F.col(text).isNotNull() & F.col(topic).isNotNull()).agg(F.count_distinct(topic).alias("g"))
    df = c.groupBy("term").agg(F.count("*").alias("df"))
    scored = c.join(df, "term").crossJoin(F.broadcast(groups)).withColumn("s", F.round(F.col("c") * F.log(1 + F.col("g") / F.col("df")), 9))  # groups: one row
    w = Window.partitionBy(topic).orderBy(F.desc("s"), "term")
    return scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(topic, "r", "term")


def top_entities(chunk_topics: DataFrame, mentions: DataFrame, entities: DataFrame, k: int = 4) -> DataFrame:
    """(run_id, topic, r, entity): the specific entities that most chunks of a topic mention."""
    m = mentions.select("run_id", "chunk_id", "entity").distinct().join(entities.filter("specific").select("run_id", "entity"), ["run_id", "entity"])
    c = chunk_topics.join(m, ["run_id", "chunk_id"]).groupBy("run_id", "topic", "entity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("run_id", "topic").orderBy(F.desc("c"), "entity")
    return c.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("run_id", "topic", "r", "entity")


def concept_topics(groups: DataFrame, mentions: DataFrame) -> DataFrame:
    """(run_id, topic, chunk_id): chunks that mention two concepts of a community, or one of a community of two.

    ``groups``: (run_id, entity, community); ``mentions``: (run_id, chunk_id, entity). A chunk may be in several topics.
    """
    size = groups.groupBy("run_id", "community").agg(F.count("*").alias("n"))
    need = F.when(F.col("n") >= 3, 2).otherwise(1)
    c = mentions.select("run_id", "chunk_id", "entity").distinct().join(groups, ["run_id", "entity"]).groupBy("run_id", "community", "chunk_id").agg(F.count("*").alias("k"))
    return c.join(size, ["run_id", "community"]).filter(F.col("k") >= need).select("run_id", F.col("community").alias("topic"), "chunk_id")


def topic_profile(chunk_topics: DataFrame, chunks: DataFrame, papers: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(run_id, topic, chunks, papers, density, recent_share, max_similarity, novelty).

    ``chunks``: (run_id, chunk_id, paper_id); ``papers``: (run_id, paper_id, year); ``vectors``: (chunk_id, embedding).
    Density is the papers over the median of the run's topics of two papers or more (of all, without one), 1 at most;
    novelty is half the distance to the nearest other topic of at least median size (0.3 counts fully) and half the share
    of papers of the last two years. Without a vector a topic's similarity is 0, its distance nil.
    """
    j = chunk_topics.join(chunks, ["run_id", "chunk_id"])
    ref = papers.groupBy("run_id").agg(F.max("year").alias("ref"))
    per = j.select("run_id", "topic", "paper_id").distinct().join(papers, ["run_id", "paper_id"], "left").join(ref, "run_id", "left")
    t = per.groupBy("run_id", "topic").agg(F.count("*").alias("papers"), F.sum(F.coalesce((F.col("year") >= F.col("ref") - 1).cast("int"), F.lit(0))).alias("recent"))
    t = t.join(j.groupBy("run_id", "topic").agg(F.count("*").alias("chunks")), ["run_id", "topic"])
    several = F.expr("median(case when papers >= 2 then papers end)")
    middle = t.groupBy("run_id").agg(F.coalesce(several, F.expr("median(papers)")).alias("middle"))
    t = t.join(middle, "run_id").withColumn("density", F.round(F.least(F.lit(1.0), F.col("papers") / F.col("middle")), 4)).withColumn("recent_share", F.col("recent") / F.col("papers"))
    if vectors is None:
        near = t.select("run_id", "topic", F.lit(0.0).alias("max_similarity"), F.lit(False).alias("known"))
    else:
        c = centroids(chunk_topics.join(vectors, "chunk_id"), ["run_id", "topic"])
        large = t.filter(F.col("papers") >= F.col("middle")).select("run_id", "topic").join(c, ["run_id", "topic"]).select("run_id", F.col("topic").alias("other"), F.col("centroid").alias("o"))
        dot = F.aggregate(F.zip_with("centroid", "o", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        near = c.join(large, "run_id", "left").groupBy("run_id", "topic").agg(F.coalesce(F.max(F.when(F.col("topic") != F.col("other"), dot)), F.lit(0.0)).alias("max_similarity"), F.lit(True).alias("known"))
    t = t.join(near, ["run_id", "topic"], "left")
    apart = F.when(F.coalesce("known", F.lit(False)), 1 - F.col("max_similarity")).otherwise(1.0)
    novelty = 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), apart / 0.3)) + 0.5 * F.col("recent_share")
    return t.select("run_id", "topic", "chunks", "papers", "density", F.round("recent_share", 4).alias("recent_share"), F.round(F.coalesce("max_similarity", F.lit(0.0)), 4).alias("max_similarity"), F.round(novelty, 4).alias("novelty"))


def topic_of(evidence: DataFrame, chunk_topics: DataFrame, profile: DataFrame) -> DataFrame:
    """(run_id, gap_id, topic): the topic of most of a gap's chunks; a chunk of several counts for the one of fewest papers, ties by topic."""
    one = chunk_topics.join(profile.select("run_id", "topic", "papers"), ["run_id", "topic"]).groupBy("run_id", "chunk_id").agg(F.min_by("topic", F.struct("papers", "topic")).alias("topic"))
    v = evidence.select("run_id", "gap_id", "chunk_id").distinct().join(one, ["run_id", "chunk_id"]).groupBy("run_id", "gap_id", "topic").agg(F.count("*").alias("v"))
    return v.groupBy("run_id", "gap_id").agg(F.min_by("topic", F.struct(-F.col("v"), "topic")).alias("topic"))


def sparse_topics(profile: DataFrame) -> DataFrame:
    """Topics thin enough to be a candidate: two papers or more, a density of SPARSE_TOPIC at most and, where known, a ``relevance`` near the run's upper median."""
    t = profile.filter((F.col("density") <= SPARSE_TOPIC) & (F.col("papers") >= 2))
    if "relevance" not in profile.columns:
        return t
    w = Window.partitionBy("run_id").orderBy("relevance")
    r = profile.filter("relevance is not null").withColumn("i", F.row_number().over(w))
    n = r.groupBy("run_id").agg(F.count("*").alias("n"))
    gate = r.join(n, "run_id").filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("run_id", (F.col("relevance") - 0.05).alias("gate"))
    return t.join(gate, "run_id", "left").filter("relevance is null or gate is null or relevance >= gate").drop("gate")


def fused(guests: DataFrame, hosts: DataFrame) -> DataFrame:
    """(run_id, gap_id, detectors): stated candidates with the detectors that join them, and candidates that stand alone.

    ``hosts``: (run_id, gap_id, place, core, chunks) of stated candidates; ``guests``: (run_id, gap_id, detector, concepts,
    chunks). A pair of concepts joins the first host, by place, whose core contains it or, of two or more, resembles it by
    0.6; a stale concept one whose first core entity it is; a topic one with two chunks in common or a core that resembles
    its concepts by 0.5. Guests and hosts meet by a shared concept or chunk, never all with all.
    """
    h = hosts.select("run_id", F.col("gap_id").alias("host"), "place", "core", F.col("chunks").alias("own"))
    g = guests.select("run_id", "gap_id", "detector", "concepts", "chunks")
    by_concept = g.select("*", F.explode("concepts").alias("k")).join(h.select("*", F.explode("core").alias("k")), ["run_id", "k"])
    by_chunk = g.filter("detector = 'topic_density'").select("*", F.explode("chunks").alias("k")).join(h.select("*", F.explode("own").alias("k")), ["run_id", "k"])
    pairs = by_concept.unionByName(by_chunk).drop("k").distinct()
    like = jaccard(F.array_distinct("concepts"), F.array_distinct("core"))
    fits = (
        F.when(F.col("detector") == "combination_sparsity", (F.size(F.array_except("concepts", "core")) == 0) | ((F.size("core") >= 2) & (like >= 0.6)))
        .when(F.col("detector") == "temporal_staleness", F.array_contains("concepts", F.get("core", F.lit(0))))
        .otherwise((F.size(F.array_intersect("chunks", "own")) >= 2) | (like >= 0.5))
    )
    met = pairs.filter(fits).groupBy("run_id", "gap_id", "detector").agg(F.min_by("host", F.struct("place", "host")).alias("host"))
    joined = met.groupBy("run_id", "host").agg(F.array_sort(F.collect_set("detector")).alias("more"))
    stated = h.join(joined, ["run_id", "host"], "left").select("run_id", F.col("host").alias("gap_id"), F.concat(F.array(F.lit("explicit_statements")), F.coalesce("more", F.array().cast("array<string>"))).alias("detectors"))
    alone = g.join(met.select("run_id", "gap_id"), ["run_id", "gap_id"], "left_anti").select("run_id", "gap_id", F.array("detector").alias("detectors"))
    return stated.unionByName(alone)


def full_score(candidates: DataFrame) -> DataFrame:
    """Adds gap_score, baseline_score, and the parts they are made of.

    ``candidates``: (support, stating_papers, sparsity_raw, staleness, external, span, novelty, detectors, on_topic_papers).
    Sparsity counts less in a run of fewer than SMALL_CORPUS papers; staleness known from less than four years of the run
    alone weighs half. Null staleness and novelty leave the rest its weights; contradiction is never known.
    """
    c = candidates.withColumn("explicit", F.when(F.col("support") > 0, 1 - F.exp(-F.col("support") / 2)).otherwise(0.0))
    c = c.withColumn("sparsity", F.col("sparsity_raw") * F.least(F.lit(1.0), F.col("on_topic_papers") / SMALL_CORPUS)).withColumn("independence", F.least(F.col("stating_papers") / SATURATION, F.lit(1.0)))
    c = c.withColumn("agreement", F.least((F.size(F.array_distinct("detectors")) - 1) / 3, F.lit(1.0)))
    half = F.when(~F.coalesce("external", F.lit(False)) & (F.coalesce("span", F.lit(0)) < 4), 0.5).otherwise(1.0)
    weights = {k: F.lit(v) for k, v in GAP_WEIGHTS.items()} | {"staleness": GAP_WEIGHTS["staleness"] * half}
    values = {k: F.col(k) for k in ("explicit", "sparsity", "staleness", "novelty", "independence")}
    c = c.withColumn("gap_score", F.round(F.least(F.lit(1.0), weighted_mean(values, weights) + 0.10 * F.col("agreement")) + 1e-9, 4))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return c.withColumn("baseline_score", F.round(BASELINE["sparsity"] * F.col("sparsity_raw") + BASELINE["staleness"] * zero("staleness") + BASELINE["novelty"] * zero("novelty") + 1e-9, 4))


def baseline_rank(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``baseline_rank``: by baseline_score, ties by ``rank``."""
    return ranked.withColumn("baseline_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("baseline_score"), "rank")))


def base_score(confidence: Column, papers: Column, passages: Column, evidence: Column) -> Column:
    """Score of a candidate before duplicates and diversity: confidence and breadth, blended with the evidence score where there is one."""
    sure = F.when(confidence.isNull() | F.isnan(confidence), 0.0).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))
    own = 0.6 * sure + 0.25 * F.least(papers / 3, F.lit(1.0)) + 0.15 * F.least(passages / 5, F.lit(1.0))
    other = F.when(evidence.isNotNull() & ~F.isnan(evidence), F.least(F.greatest(evidence, F.lit(0.0)), F.lit(1.0)))
    return F.when(other.isNull(), own).otherwise(0.5 * own + 0.5 * other)


def interleaved(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` of a run for validation: signal and llm candidates by turns, in their ranks; only signals where there are no others.

    ``candidates``: (run_id, gap_id, source, rank); a source other than "llm" counts as signal.
    """
    side = F.when(F.col("source") == "llm", 1).otherwise(0)
    c = candidates.withColumn("side", side).withColumn("turn", F.row_number().over(Window.partitionBy("run_id", "side").orderBy("rank", "gap_id")))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("turn", "side")))
    return c.filter(F.col("place") <= limit).drop("side", "turn")

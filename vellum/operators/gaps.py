"""Candidate gaps: statements, sparse combinations, stale topics, scores and ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scores import sigmoid, weighted_mean
from vellum.functions.text import jaccard, sentences

# Strength of a statement by the section it stands in.
SECTION_WEIGHTS = {
    "LIMITATIONS": 1.0, "FUTURE_WORK": 1.0, "CONCLUSION": 0.9, "DISCUSSION": 0.9, "RESULTS": 0.6, "LITERATURE_REVIEW": 0.7,
    "RELATED_WORK": 0.7, "BACKGROUND": 0.6, "INTRODUCTION": 0.6, "ABSTRACT": 0.6, "OTHER": 0.5, "UNKNOWN": 0.5,
}
# Cues of a statement, strongest first.
CUES = [
    ("OPEN_PROBLEM", 1.0, r"(?i)\b(remain(s|ed)?\s+(largely\s+)?(unexplored|unaddressed|unresolved|unclear|understudied|under-explored|an open|a (major|key|significant|critical) challenge|challenging)|(has|have)\s+(not|rarely|seldom)\s+been\s+(studied|explored|investigated|addressed|examined|evaluated|considered)|(few|limited|no)\s+(prior\s+)?(studies|works|research|attempts)\s+(have\s+)?(explored|addressed|investigated|examined|focus|focused|considered)|(is|are)\s+(still\s+)?(lacking|missing|scarce|rare)|open (problem|issue|question|challenge)s?|(several|many|important|critical|key)\s+challenges\s+(remain|persist|are yet)|yet to be (overcome|addressed|explored|resolved)|research gap)"),
    ("LIMITATION", 0.8, r"(?i)\b(limited (to|by|in|generali[sz]ation|ability|capability|applicability)|is limited|are limited|remains limited|limitations? (of|in|include)|only (tested|evaluated|validated|trained|applied|considered)\s+on|on a single|single[- ](dataset|centre|center|modality|disease|type)|lack(s|ing)?\s+of|lack\s+(the|a|an|sufficient|adequate)|insufficient|inadequate|(struggle|fail)(s|ed)?\s+(to|with)|suffer(s|ed)?\s+from|(is|are)\s+(sensitive|prone)\s+to|(depend(s|ence|ency)?|reliance|rel(y|ies) heavily)\s+on\s+(large|labell?ed|annotated|manual|expert)|restricts?\s+(their|its)\s+applicability|tend to focus on|focus (mainly|primarily|only) on|(does|do|did) not (account|consider|address|generali[sz]e|capture|handle)|overlook(s|ed|ing)?|(poor|reduced|degraded|low) (generali[sz]ation|performance|robustness|interpretability))"),
    ("FUTURE_WORK", 0.6, r"(?i)\b(future (work|research|studies|directions?|efforts?)\s+(should|could|will|may|might|need|needs|must|is|are|can|include|includes|on|to|in)|in (the )?future,? (we|it|research|studies|work)|remains? to be (seen|explored|investigated|studied|determined)|(could|should|need to|needs to|must) be (further )?(explored|investigated|studied|addressed|extended|validated|evaluated)|further (research|work|studies|investigation|validation) (is|are) (needed|required|necessary|warranted)|warrants? further|calls? for|there is a need|need for (more|further|larger|robust|better))"),
]
# Weights of the gap score and of the score before validation.
GAP_WEIGHTS = {"explicit": 0.25, "sparsity": 0.25, "staleness": 0.15, "novelty": 0.10, "contradiction": 0.10, "independence": 0.15}
EVIDENCE_WEIGHTS = {"relevance": 0.35, "quality": 0.20, "recency": 0.15, "independence": 0.30}


# Headings of sections that speak of gaps whatever their type.
GAP_HEADING = r"(?i)research gap|limitation|challenge|open (problem|issue|question)|future (work|direction|research)|discussion|conclusion"


def section_weight(kind: Column, title: Column) -> Column:
    """Weight of a section by its type, 0.9 at least under a heading that speaks of gaps."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])[F.upper(F.coalesce(kind, F.lit("UNKNOWN")))], F.lit(0.5))
    return F.when(F.coalesce(title.rlike(GAP_HEADING), F.lit(False)), F.greatest(weight, F.lit(0.9))).otherwise(weight)


def gap_statements(chunks: DataFrame, key: str = "doc_id", title: str | None = None, paper: str | None = None) -> DataFrame:
    """(key, section_type, sentence, cue, strength) of sentences that state a gap, by their strongest cue and their section's weight.

    ``chunks``: (key, section_type, text) and, where given, a ``title`` and ``paper``, which is handed on. Sentences that
    ``rejection`` names a reason for are left out: of fewer than 8 or more than 70 words, about the paper itself, page
    headers, citations, tables. Of one paper (else one key) a sentence counts once, whatever its case: that of the least key.
    """
    from vellum.operators.evidence import rejection

    owner = paper or key
    head = F.col(title) if title else F.lit(None).cast("string")
    s = chunks.select(*dict.fromkeys([key, owner]), "section_type", section_weight(F.col("section_type"), head).alias("weight"), F.explode(sentences(F.col("text"))).alias("sentence"))
    cue, base = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, strength, pattern in reversed(CUES):
        hit = F.col("sentence").rlike(pattern)
        cue, base = F.when(hit, name).otherwise(cue), F.when(hit, strength).otherwise(base)
    s = s.withColumn("cue", cue).filter("cue is not null").filter(rejection(F.col("sentence")).isNull()).withColumn("strength", F.round(base * F.col("weight"), 4))
    rest = ["section_type", "sentence", "cue", "strength"]
    first = F.min(F.struct(key, *rest)).alias("s")
    one = s.groupBy(F.col(owner).alias("_owner"), F.lower("sentence").alias("_low")).agg(first)
    return one.select(*([F.col("_owner").alias(paper)] if paper and paper != key else []), F.col(f"s.{key}").alias(key), *[F.col(f"s.{c}").alias(c) for c in rest])


def explicit_support(statements: DataFrame, group: list[str], paper: str) -> DataFrame:
    """Per group: papers, support (each paper's strongest statement) and 1 - exp(-support / 2)."""
    best = statements.groupBy(*group, paper).agg(F.max("strength").alias("s"))
    return best.groupBy(*group).agg(F.count("*").alias("papers"), F.round(F.sum("s"), 6).alias("support"), F.round(1 - F.exp(-F.sum("s") / 2), 6).alias("explicit"))


def combination_sparsity(entity_paper: DataFrame, sizes: DataFrame, edges: DataFrame, type_pairs: DataFrame, least_papers: int = 3, most_lift: float = 0.35, least_expected: float = 1.5, least_link: float = 0.25, limit: int | None = None) -> DataFrame:
    """Pairs of entities of fitting types that meet more rarely than expected though their neighbours overlap.

    ``type_pairs``: (ta, tb), a list of a few rows; ``limit``: the best of each run. Entities of too few papers
    can't reach ``least_expected`` with the most frequent one and leave before
    the pairs are made within a run and type pair.
    """
    kind = lambda c: F.element_at(F.split(c, ":"), 1)
    freq = entity_paper.groupBy("run_id", "entity").agg(F.count("*").alias("f")).filter(F.col("f") >= least_papers).join(sizes, "run_id")
    top = freq.groupBy("run_id").agg(F.max("f").alias("top"))
    freq = freq.join(top, "run_id").filter(F.col("f") * F.col("top") / F.col("n") >= least_expected).withColumn("kind", kind("entity"))
    a = freq.join(type_pairs, F.col("kind") == F.col("ta")).select("run_id", F.col("entity").alias("a"), F.col("f").alias("fa"), "n", "tb")
    b = freq.select("run_id", F.col("entity").alias("b"), F.col("f").alias("fb"), F.col("kind").alias("tb"))
    pairs = a.join(b, ["run_id", "tb"]).filter(F.col("fa") * F.col("fb") / F.col("n") >= least_expected)
    pairs = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    both = edges.select("run_id", F.col("a").alias("lo"), F.col("b").alias("hi"), "papers")
    pairs = pairs.join(both, ["run_id", "lo", "hi"], "left").withColumn("observed", F.coalesce("papers", F.lit(0)))
    pairs = pairs.withColumn("expected", F.col("fa") * F.col("fb") / F.col("n")).withColumn("lift", F.col("observed") / F.col("expected")).filter(F.col("lift") <= most_lift)
    strong = edges.filter("pmi > 0")
    near = strong.select("run_id", "a", "b").unionByName(strong.select("run_id", F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.groupBy("run_id", F.col("a").alias("e")).agg(F.collect_set("b").alias("near"))
    for side in "ab":
        pairs = pairs.join(near.select("run_id", F.col("e").alias(side), F.col("near").alias(f"n{side}")), ["run_id", side], "left")
    none = F.array().cast("array<string>")
    na, nb = F.array_except(F.coalesce("na", none), F.array("b")), F.array_except(F.coalesce("nb", none), F.array("a"))
    out = pairs.filter("a <> b").withColumn("link", jaccard(na, nb)).filter(F.col("link") >= least_link)
    sparsity = 1 - F.least(F.col("lift"), F.lit(1.0))
    out = out.select("run_id", "a", "b", "fa", "fb", "observed", F.round("expected", 3).alias("expected"), F.round("lift", 4).alias("lift"), F.round(sparsity, 4).alias("sparsity"), F.round("link", 4).alias("link"), F.round(sparsity * (0.5 + 0.5 * F.col("link")), 4).alias("score"))
    if limit is None:
        return out
    best = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("score"), "a", "b"))
    return out.withColumn("r", best).filter(F.col("r") <= limit).drop("r")


def internal_staleness(entity_years: DataFrame, paper_years: DataFrame, span: int = 5) -> DataFrame:
    """(run_id, entity, last_year, slope, tau): how long ago and how fast an entity left the run's papers.

    ``entity_years``: (run_id, entity, year, papers); ``paper_years``: (run_id, year, total). The
    slope is that of the yearly share over the last ``span`` years that have papers.
    """
    last = paper_years.groupBy("run_id").agg(F.max("year").alias("ref"))
    window = paper_years.join(last, "run_id").filter(F.col("year") > F.col("ref") - span)
    entities = entity_years.groupBy("run_id", "entity").agg(F.max("year").alias("last_year"))
    grid = entities.join(window, "run_id").join(entity_years, ["run_id", "entity", "year"], "left")
    share = F.coalesce("papers", F.lit(0)) / F.col("total")
    slope = grid.groupBy("run_id", "entity").agg(F.max("last_year").alias("last_year"), F.max("ref").alias("ref"), F.coalesce(F.regr_slope(share, F.col("year").cast("double")), F.lit(0.0)).alias("slope"))
    tau = 0.6 * F.least(F.lit(1.0), (F.col("ref") - F.col("last_year")) / span) + 0.4 * sigmoid(-20 * F.col("slope"))
    return slope.select("run_id", "entity", "last_year", F.round("slope", 4).alias("slope"), F.round(tau, 4).alias("tau"))


def external_staleness(series: DataFrame, keys: list[str], this_year: int) -> DataFrame:
    """(keys, share, tau) from (keys, year, papers, field): the trend of an entity's share of its field.

    Of the last six complete years those with a field count; three are needed.
    1 without any paper, or without one in the last two years.
    """
    s = series.filter((F.col("year") < this_year) & (F.col("year") >= this_year - 6) & (F.col("field") > 0)).withColumn("share", F.col("papers") / F.col("field"))
    recent = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("year"))) <= 2
    s = s.withColumn("recent", F.when(recent, F.col("papers")).otherwise(0))
    a = s.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("share").alias("share"), F.regr_slope(F.col("share"), F.col("year").cast("double")).alias("slope"), F.sum("recent").alias("r")).filter("n >= 3")
    tau = F.when((F.col("share") <= 0) | (F.col("r") == 0), 1.0).otherwise(1 / (1 + F.exp(8 * F.col("slope") / F.col("share"))))
    return a.select(*keys, F.round("share", 5).alias("share"), F.round(tau, 4).alias("tau"))


def gap_score(features: DataFrame, agreement: Column) -> DataFrame:
    """Adds ``gap_score``: weights scaled to the features that are known, a tenth of the detectors' agreement, 1 at most."""
    values = {k: F.col(k) for k in GAP_WEIGHTS if k in features.columns}
    return features.withColumn("gap_score", F.round(F.least(F.lit(1.0), weighted_mean(values, GAP_WEIGHTS) + 0.10 * agreement), 4))


def diversity_rank(rows: DataFrame, score: str, kind: str, statement: str, penalty: float = 0.05, most: int | None = 2, ascending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank_score`` and ``rank``: greedy ranking in which each earlier row of a type costs a penalty.

    Within a type rows leave in order of their score, so the j-th carries the
    penalty of j rows (``most`` at most) and the greedy order is one global sort.
    """
    by = by or []
    tie = F.col(statement).asc() if ascending else F.col(statement).desc()
    j = F.row_number().over(Window.partitionBy(*by, kind).orderBy(F.desc(score), tie)) - 1
    rows = rows.withColumn("rank_score", F.round(F.col(score) - penalty * (F.least(j, F.lit(most)) if most is not None else j), 6))
    w = Window.partitionBy(*by).orderBy(F.desc("rank_score"), F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w))


def prescore(items: DataFrame, saturation: int = 3, penalty: float = 1.0) -> DataFrame:
    """Per gap the evidence-weighted score before validation.

    ``items``: (gap_id, paper_id, stance, relevance, quality, recency); stance
    SUPPORTING or COUNTER. Status by the share of counter mass: SUPPORTED at 0,
    CONTESTED below a half, else CONTRADICTED; INSUFFICIENT_EVIDENCE without support.
    """
    own = {k: EVIDENCE_WEIGHTS[k] for k in ("relevance", "quality", "recency")}
    quality = F.when(F.col("stance") == "SUPPORTING", F.col("quality"))
    s = items.withColumn("strength", weighted_mean({"relevance": F.col("relevance"), "quality": quality, "recency": F.col("recency")}, own))
    sup = F.col("stance") == "SUPPORTING"
    g = s.groupBy("gap_id").agg(
        F.avg(F.when(sup, F.col("relevance"))).alias("relevance"), F.avg(F.when(sup, F.col("quality"))).alias("quality"), F.avg(F.when(sup, F.col("recency"))).alias("recency"),
        F.count_distinct(F.when(sup, F.col("paper_id"))).alias("papers"), F.sum(F.when(sup, F.col("strength")).otherwise(0.0)).alias("for_mass"), F.sum(F.when(sup, 0.0).otherwise(F.col("strength"))).alias("against"),
        F.sum(sup.cast("int")).alias("n"),
    )
    values = {"relevance": F.col("relevance"), "quality": F.col("quality"), "recency": F.col("recency"), "independence": F.least(F.col("papers") / saturation, F.lit(1.0))}
    mass = F.col("for_mass") + F.col("against")
    ratio = F.when(F.col("n") == 0, (F.col("against") > 0).cast("double")).when(mass > 0, F.col("against") / mass).otherwise(0.0)
    g = g.withColumn("support", F.when(F.col("n") > 0, weighted_mean(values, EVIDENCE_WEIGHTS)).otherwise(0.0)).withColumn("ratio", ratio)
    status = F.when(F.col("n") == 0, "INSUFFICIENT_EVIDENCE").when(F.col("ratio") == 0, "SUPPORTED").when(F.col("ratio") < 0.5, "CONTESTED").otherwise("CONTRADICTED")
    return g.select("gap_id", F.round("support", 6).alias("support_score"), F.round("ratio", 6).alias("contradiction_ratio"), F.round(F.col("support") * (1 - penalty * F.col("ratio")), 6).alias("score"), status.alias("status"))


def consensus_clusters(statements: DataFrame, by: str, least: float = 0.72) -> DataFrame:
    """(by, statement, cluster): average-linkage clusters of the statements' vectors, per group of a bounded size (a run).

    Merges the two clusters of the highest mean cosine while it is at least
    ``least``; clusters are numbered by size, then first statement.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("statement", kind="stable").reset_index(drop=True)
        x = np.stack(pdf.embedding.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        sim = x @ x.T
        np.fill_diagonal(sim, -np.inf)
        size = np.ones(len(x))
        member = [[i] for i in range(len(x))]
        while len(x) > 1:
            i, j = divmod(int(sim.argmax()), len(x))
            if not sim[i, j] >= least:
                break
            i, j = min(i, j), max(i, j)
            row = (size[i] * sim[i] + size[j] * sim[j]) / (size[i] + size[j])
            sim[i], sim[:, i] = row, row
            sim[i, i] = -np.inf
            sim[j], sim[:, j] = -np.inf, -np.inf
            size[i] += size[j]
            member[i] += member[j]
            member[j] = []
        order = sorted((m for m in member if m), key=lambda m: (-len(m), min(m)))
        label = np.empty(len(x), int)
        for k, m in enumerate(order):
            label[m] = k
        return pd.DataFrame({by: pdf[by], "statement": pdf.statement, "cluster": label})

    kind = dict(statements.dtypes)[by]
    return statements.select(by, "statement", "embedding").groupBy(by).applyInPandas(cluster, f"{by} {kind}, statement string, cluster int")


def topic_density(members: DataFrame, topic: str = "label") -> DataFrame:
    """(topic, papers, density): papers over the median of the topics of more than one, 1 at most."""
    n = members.groupBy(topic).agg(F.count("*").alias("papers"))
    middle = n.filter("papers > 1").agg(F.median("papers").alias("m"))
    return n.crossJoin(F.broadcast(middle)).select(topic, "papers", F.round(F.least(F.lit(1.0), F.col("papers") / F.col("m")), 6).alias("density"))

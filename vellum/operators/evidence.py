"""Claims, rejected sentences, later work, and the joining of detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scores import cosine
from vellum.functions.text import jaccard, sentences

# Words of a positive and of a negative result, and metric names with their values.
POSITIVE = r"(?i)\b(outperform(?:s|ed)?|improv(?:e|es|ed|ement)|higher (?:accuracy|performance|sensitivity|specificity|auc|f1)|better than|achiev(?:e|es|ed)\s+(?:an?\s+)?(?:accuracy|performance|score|auc|f1)|increase[sd]?\s+(?:the\s+)?(?:accuracy|performance|sensitivity|specificity|auc|f1))\b"
NEGATIVE = r"(?i)\b(fail(?:s|ed)?|worse than|underperform(?:s|ed)?|no significant (?:difference|improvement)|does not improve|did not improve|not improve|lower (?:accuracy|performance|sensitivity|specificity|auc|f1)|decrease[sd]?\s+(?:the\s+)?(?:accuracy|performance|sensitivity|specificity|auc|f1))\b"
METRIC = r"(?i)\b(accuracy|auc|auroc|f1(?:-score)?|sensitivity|specificity|precision|recall|dice(?: score)?|kappa|iou)\b\s*(?:was|of|=|:)?\s*(\d+(?:\.\d+)?\s*%?)"
RESULT_SECTIONS = ["RESULTS", "DISCUSSION", "ABSTRACT"]
ADDRESSING_SECTIONS = ["METHODS", "METHODOLOGY", "MODEL", "RESULTS", "EXPERIMENTS", "EVALUATION", "ABSTRACT"]
# Sentences about the paper itself, its motivation, page headers, citation runs and tables.
SELF_REFERENCE = r"(?i)\b(this (app|application|tool|website|interface|project|chatbot)|our (app|application|tool|website|interface|chatbot)|user[- ]friendly|user interface|graphical interface|the proposed (system|application) (offers|provides|allows)|we (propose|present|introduce|develop|developed|proposed) (a|an|the)\b(?!.*\b(lack|limited|fail|challenge)))"
CONTRIBUTION = r"(?i)\b(the proposed (system|method|model|framework|approach|architecture|technique|pipeline)|our (proposed )?(method|model|framework|approach|system|architecture|study|work)|(we|this (study|paper|work|research|project|review)) (propose[sd]?|present(s|ed)?|implement(s|ed)?|develop(s|ed)?|introduce[sd]?|overcome[s]?|address(es|ed)?|tackle[sd]?|demonstrate[sd]?|achieve[sd]?)|to (overcome|address|tackle|mitigate) (the|these|this|such|those)|overcomes? (the|these) limitations?|(advantages|benefits) over|(resolve[sd]?|alleviate[sd]?|mitigate[sd]?|solve[sd]?|eliminate[sd]?)\b)"
MOTIVATION = r"(?i)^\s*(traditional|conventional|manual|current clinical|existing clinical)\b"
PAGE_HEADER = r"(?i)\b(volume\s*\d+|issue\s*\d+|page:?\s*\d+|issn|e-issn|doi:|https?://|www\.)"
CITATION_RUN = r"(\[\d{1,3}\][^\[]{0,80}){2,}"
TABLE_HEADER = r"(?i)\b(gap category|description\s*&|implications\b.*\bdescription)"
TABLE_LIKE = r"(?i)\blimitations? of the paper\b|\bfollow-ups?:|(\b(accuracy|precision|recall|f1)\b[^.]{0,40}?\d+(\.\d+)?\s*%.*){2,}|(•[^•]{0,200}){3,}"
TABLE_ROWS = r"(\b\d{1,3}\s+[A-Z][a-z]+(\s+[A-Z][a-z-]+){2,}.*){2,}"


def rejection(sentence: Column) -> Column:
    """Why a sentence can't be a gap statement, by the first rule that holds; null if none does."""
    words = F.split(F.trim(sentence), r"\s+")
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) / n
    return (
        F.when((n < 8) | (n > 70), "LENGTH")
        .when(sentence.rlike(SELF_REFERENCE), "SELF_REFERENCE")
        .when(sentence.rlike(CONTRIBUTION), "CONTRIBUTION")
        .when(sentence.rlike(MOTIVATION), "MOTIVATION")
        .when(sentence.rlike(PAGE_HEADER), "PAGE_HEADER")
        .when(sentence.rlike(CITATION_RUN) | F.ltrim(sentence).startswith("["), "CITATIONS")
        .when(sentence.rlike(TABLE_HEADER), "TABLE_HEADER")
        .when((capital > 0.55) | ((n > 15) & (capital > 0.42)), "CAPITALS")
        .when(sentence.rlike(TABLE_LIKE) | sentence.rlike(TABLE_ROWS), "TABLE")
    )


def direction(sentence: Column) -> Column:
    """POSITIVE, NEGATIVE or MIXED; null without either."""
    up, down = sentence.rlike(POSITIVE), sentence.rlike(NEGATIVE)
    return F.when(up & down, "MIXED").when(up, "POSITIVE").when(down, "NEGATIVE")


def result_claims(chunks: DataFrame, key: str = "chunk_id", vocabulary: dict[str, str] | None = None) -> DataFrame:
    """(key, sentence, direction, metric, value, entities): sentences of result sections with a direction, each once per chunk whatever its case.

    With a ``vocabulary`` (forms to entity ids) only sentences that name a METHOD and a DATASET or TASK are claims; only
    sentences with a direction are tagged. Without one ``entities`` is empty.
    """
    from vellum.operators.graph import tag_entities

    s = chunks.filter(F.upper("section_type").isin(RESULT_SECTIONS)).select(key, F.explode(sentences(F.col("text"))).alias("sentence"))
    s = s.withColumn("direction", direction(F.col("sentence"))).filter("direction is not null")
    s = s.groupBy(key, F.lower("sentence").alias("low")).agg(F.min(F.struct("sentence", "direction")).alias("s")).select(key, "s.*")
    found = lambda k: F.nullif(F.trim(F.regexp_extract("sentence", METRIC, k)), F.lit(""))
    s = s.select(key, "sentence", "direction", F.lower(found(1)).alias("metric"), found(2).alias("value"))
    if vocabulary is None:
        return s.withColumn("entities", F.array().cast("array<string>"))
    tags = tag_entities(s.select("sentence").distinct(), vocabulary, "sentence", "sentence").groupBy("sentence").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    has = lambda *kinds: F.exists("entities", lambda e: F.element_at(F.split(e, ":", 2), 1).isin(*kinds))
    return s.join(tags, "sentence").filter(has("METHOD") & has("DATASET", "TASK")).select(key, "sentence", "direction", "metric", "value", "entities")


def addressed_later(gaps: DataFrame, chunk_entities: DataFrame, stating: DataFrame, limit: int = 5) -> DataFrame:
    """(gap_id, chunk_id, paper_id, year): chunks that mention all of a gap's concepts in a paper newer than its last statement.

    ``gaps``: (gap_id, concepts, latest), gaps of one concept or an unknown year
    are left out; ``chunk_entities``: (chunk_id, paper_id, year, section_type,
    entity); ``stating``: (gap_id, paper_id). One chunk a paper, ``limit`` a gap.
    """
    need = gaps.filter((F.size("concepts") >= 2) & F.col("latest").isNotNull()).select("gap_id", "latest", F.size("concepts").alias("k"), F.explode("concepts").alias("entity"))
    later = chunk_entities.filter(F.col("section_type").isin(ADDRESSING_SECTIONS)).join(need, "entity").filter(F.col("year") > F.col("latest"))
    whole = later.groupBy("gap_id", "chunk_id", "paper_id", "year", "k").agg(F.count_distinct("entity").alias("n")).filter("n = k")
    whole = whole.join(stating, ["gap_id", "paper_id"], "left_anti")
    one = whole.withColumn("c", F.row_number().over(Window.partitionBy("gap_id", "paper_id").orderBy("chunk_id"))).filter("c = 1")
    return one.withColumn("r", F.row_number().over(Window.partitionBy("gap_id").orderBy("year", "chunk_id"))).filter(F.col("r") <= limit).select("gap_id", "chunk_id", "paper_id", "year")


def host_of(guests: DataFrame, hosts: DataFrame, least: float = 0.6) -> DataFrame:
    """(grp, guest, host): the first host, by its place, whose core contains a guest's concepts or resembles them.

    ``guests``: (grp, guest, concepts); ``hosts``: (grp, host, place, core). A fitting host shares a
    concept, so pairs are made by concept and not all with all.
    """
    g = guests.select("grp", "guest", "concepts", F.explode("concepts").alias("c"))
    h = hosts.select("grp", "host", "place", "core", F.explode("core").alias("c"))
    pairs = g.join(h, ["grp", "c"]).select("grp", "guest", "host", "place", "concepts", "core").distinct()
    fits = (F.size(F.array_except("concepts", "core")) == 0) | ((F.size("core") >= 2) & (jaccard(F.col("concepts"), F.col("core")) >= least))
    return pairs.filter(fits).groupBy("grp", "guest").agg(F.min_by("host", F.struct("place", "host")).alias("host"))


def grounded(statements: DataFrame, evidence: DataFrame, least: float = 0.60) -> DataFrame:
    """(gap_id, best, grounded): the greatest cosine of a statement's vector with those of its evidence."""
    j = statements.select("gap_id", F.col("embedding").alias("s")).join(evidence.select("gap_id", F.col("embedding").alias("e")), "gap_id", "left")
    g = j.groupBy("gap_id").agg(F.round(F.coalesce(F.max(cosine(F.col("s"), F.col("e"))), F.lit(0.0)), 6).alias("best"))
    return g.withColumn("grounded", F.col("best") >= least)


def merge_candidates(signal: DataFrame, llm: DataFrame, least: float = 0.8) -> DataFrame:
    """(statement, origin): signal candidates by place, then the llm candidates that resemble none; origin signal, llm or signal+llm.

    Both: (statement, place). Statements resemble each other if their terms have a Jaccard of ``least`` or their letters
    and numbers are the same; a proposal joins the first it resembles.
    """
    from vellum.operators.neardup import near_sets, statement_sets

    a, b = (statement_sets(t.select("statement").distinct(), "statement", "statement") for t in (signal, llm))
    equal = a.filter("key <> ''").select(F.col("id").alias("a"), "key").join(b.select(F.col("id").alias("b"), "key"), "key").select("a", "b")
    near = near_sets(a.select("id", "terms"), b.select("id", "terms"), least).select("a", "b").unionByName(equal).distinct()
    near = near.join(signal.groupBy("statement").agg(F.min("place").alias("place")).withColumnRenamed("statement", "a"), "a").groupBy("b").agg(F.min_by("a", F.struct("place", "a")).alias("statement"))
    both = signal.join(near.select("statement").distinct().withColumn("hit", F.lit(True)), "statement", "left")
    first = both.select("statement", F.when(F.col("hit"), "signal+llm").otherwise("signal").alias("origin"))
    rest = llm.join(near.select(F.col("b").alias("statement")), "statement", "left_anti").select("statement", F.lit("llm").alias("origin"))
    return first.unionByName(rest)


def external_coverage(documents: DataFrame, gaps: dict[str, list[str]], text: str = "text") -> DataFrame:
    """(gap_id, joint, smallest, coverage): documents with all of up to four phrases over those with the rarest one.

    All gaps are counted in one pass over the documents.
    """
    has = lambda p: F.coalesce(F.lower(F.col(text)).contains(p.lower()), F.lit(False))
    sums, kept = [], {g: ps[:4] for g, ps in gaps.items() if len(ps[:4]) >= 2}
    for k, ps in enumerate(kept.values()):
        every = F.lit(True)
        for i, p in enumerate(ps):
            sums.append(F.sum(has(p).cast("long")).alias(f"s{k}_{i}"))
            every = every & has(p)
        sums.append(F.sum(every.cast("long")).alias(f"j{k}"))
    if not sums:
        return documents.sparkSession.createDataFrame([], "gap_id string, joint long, smallest long, coverage double")
    one = documents.agg(*sums)
    rows = F.array(*[F.struct(F.lit(g).alias("gap_id"), F.coalesce(f"j{k}", F.lit(0)).alias("joint"), F.least(*[F.coalesce(f"s{k}_{i}", F.lit(0)) for i in range(len(ps))]).alias("smallest")) for k, (g, ps) in enumerate(kept.items())])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("coverage", F.round(F.col("joint") / F.greatest(F.lit(1), F.col("smallest")), 4))


def iterate_again(iteration: int, relevant: int, retrieval: float | None, concept: float | None, most: int = 3) -> bool:
    """Whether a gap's search goes on: few relevant items or little coverage, and rounds are left."""
    if iteration >= max(1, most):
        return False
    return relevant < 5 or (retrieval is not None and retrieval < 0.5) or (concept is not None and concept < 1.0)

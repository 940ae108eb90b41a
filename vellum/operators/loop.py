"""The loop that validates gaps: queries, their refinement, search in several sources, adequacy, iteration, outcomes and their explanation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import keywords

# Words that no query needs, endings of counter queries, and how a verdict and its reason are told.
QUERY_STOP = (
    "a an the and or of in on for to with by from as at via is are was were be been that this these those there their its it which such than more most many several some other existing current models model "
    "methods method approaches approach studies study research work works papers paper often still remains remain limited lack lacking need needs future"
).split()
COUNTER = ["novel framework", "proposed method improves"]
REFINED_COUNTER = ["solved", "state of the art"]
VARIED_TYPES = ["METHOD", "DATASET", "MODALITY"]
VERDICTS = {"VALID_GAP": "holds", "UNCERTAIN_GAP": "may hold", "UNSUPPORTED_GAP": "does not hold"}


def _names(core: Column) -> Column:
    return F.transform(core, lambda e: F.element_at(F.split(e, ":", 2), 2))


def _tail(names: Column, anchor: Column) -> Column:
    """The anchor as a further word, unless a name has it or there is none."""
    within = F.exists(names, lambda n: F.contains(F.lower(n), F.lower(anchor)))
    return F.when(anchor.isNull() | within, F.array().cast("array<string>")).otherwise(F.array(anchor))


def first_queries(gaps: DataFrame, aliases: DataFrame, siblings: DataFrame) -> DataFrame:
    """(gap_id, search, place, query): what is searched first for each gap.

    ``gaps``: (gap_id, statement, core, anchor), the core as "TYPE:name"; ``aliases``: (entity, alias); ``siblings``:
    (gap_id, entity, sibling, shared) of entities of the same type that stand in for one of the core. Direct queries are
    the names (without any the statement's first five words that matter) and its first seven such words; terminology
    queries put up to two aliases for a name, method variations up to two siblings for a method, dataset or modality,
    three of each at most; counter queries ask for what solves it. A query comes once.
    """
    g = gaps.select("gap_id", "statement", "core", "anchor", _names(F.coalesce("core", F.array().cast("array<string>"))).alias("own"))
    g = g.withColumn("tail", _tail(F.col("own"), F.col("anchor"))).withColumn("names", F.when(F.size("own") > 0, F.col("own")).otherwise(keywords(F.col("statement"), QUERY_STOP, 5)))
    base = F.array_join(F.concat("names", "tail"), " ")
    words = F.array_join(F.concat(keywords(F.col("statement"), QUERY_STOP, 7), F.col("tail")), " ")
    direct = F.when(F.lower(words) == F.lower(base), F.array(base)).otherwise(F.array(base, words))
    counter = F.array(*[F.concat(base, F.lit(f" {c}")) for c in COUNTER])
    each = lambda name, queries: g.select("gap_id", F.lit(name).alias("search"), F.posexplode(queries).alias("place", "query"))
    out = each("direct", direct).unionByName(each("counter", counter))
    core = g.select("gap_id", "own", "tail", F.posexplode("core").alias("i", "entity"))
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    name = F.get("own", F.col("i"))
    a = core.join(aliases.filter(F.length("alias") > 2), "entity").filter((bare("alias") != bare(name)) & ~F.exists("own", lambda n: F.lower(n) == F.lower("alias")))
    order = [F.size(F.split("alias", " ")).desc(), F.length("alias").desc(), F.col("alias")]
    a = a.withColumn("same", F.row_number().over(Window.partitionBy("gap_id", "i", bare("alias")).orderBy(*order))).filter("same = 1")
    a = a.withColumn("k", F.row_number().over(Window.partitionBy("gap_id", "i").orderBy(*order))).filter("k <= 2")
    s = core.filter(F.element_at(F.split("entity", ":", 2), 1).isin(VARIED_TYPES)).join(siblings, ["gap_id", "entity"])
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("gap_id", "i").orderBy(F.desc("shared"), "sibling"))).filter("k <= 2").withColumn("alias", F.element_at(F.split("sibling", ":", 2), 2))
    for search, t in (("terminology", a), ("method_variation", s)):
        q = F.array_join(F.concat(F.transform("own", lambda n, j: F.when(j == F.col("i"), F.col("alias")).otherwise(n)), F.col("tail")), " ")
        t = t.select("gap_id", q.alias("query"), (F.col("i") * 10 + F.col("k")).alias("o")).groupBy("gap_id", "query").agg(F.min("o").alias("o"))
        t = t.withColumn("place", F.row_number().over(Window.partitionBy("gap_id").orderBy("o", "query")) - 1).filter("place < 3")
        out = out.unionByName(t.select("gap_id", F.lit(search).alias("search"), "place", "query"))
    return out


def gap_siblings(gaps: DataFrame, edges: DataFrame, generic: DataFrame | None = None) -> DataFrame:
    """(gap_id, entity, sibling, shared): of each core entity those of its type beside the gap's others, by the papers they share.

    ``gaps``: (gap_id, run_id, core); ``edges``: (run_id, a, b, papers). A core of one looks beside itself. ``generic``:
    (run_id, entity) that never stand in.
    """
    both = edges.select("run_id", "a", "b", "papers").unionByName(edges.select("run_id", F.col("b").alias("a"), F.col("a").alias("b"), "papers"))
    core = gaps.select("gap_id", "run_id", "core", F.explode("core").alias("entity"))
    beside = core.select("gap_id", "run_id", "entity", "core", F.explode(F.when(F.size("core") > 1, F.filter("core", lambda c: c != F.col("entity"))).otherwise(F.col("core"))).alias("a"))
    kind = lambda c: F.element_at(F.split(c, ":", 2), 1)
    j = beside.join(both, ["run_id", "a"]).filter((F.col("b") != F.col("entity")) & (kind("b") == kind("entity")))
    if generic is not None:
        j = j.join(generic.select("run_id", F.col("entity").alias("b")), ["run_id", "b"], "left_anti")
    return j.groupBy("gap_id", "entity", F.col("b").alias("sibling")).agg(F.sum("papers").alias("shared"))


def refined_queries(gaps: DataFrame, aliases: DataFrame, used: DataFrame) -> DataFrame:
    """(gap_id, search, place, query): broader queries for the next round, none of ``used`` (gap_id, query).

    Two direct ones, of all names without the anchor and of single names; two by the third to sixth alias of an entity,
    with the anchor; one counter query.
    """
    g = gaps.select("gap_id", "statement", "core", "anchor", _names(F.coalesce("core", F.array().cast("array<string>"))).alias("own"))
    g = g.withColumn("names", F.when(F.size("own") > 0, F.col("own")).otherwise(keywords(F.col("statement"), QUERY_STOP, 4)))
    joined = F.array_join("names", " ")
    direct = F.concat(F.array(joined), F.when(F.size("names") > 1, F.col("names")).otherwise(F.array().cast("array<string>")))
    counter = F.array(*[F.concat(joined, F.lit(f" {c}")) for c in REFINED_COUNTER])
    each = lambda name, queries: g.select("gap_id", F.lit(name).alias("search"), F.posexplode(queries).alias("o", "query"))
    n = F.row_number().over(Window.partitionBy("entity").orderBy("alias"))
    late = aliases.withColumn("k", n).filter("k between 3 and 6")
    term = g.select("gap_id", "anchor", F.posexplode("core").alias("i", "entity")).join(late, "entity").select("gap_id", F.lit("terminology").alias("search"), (F.col("i") * 10 + F.col("k")).alias("o"), F.concat_ws(" ", "alias", "anchor").alias("query"))
    rows = each("direct", direct).unionByName(each("counter", counter)).unionByName(term)
    fresh = rows.join(used.select("gap_id", "query").distinct(), ["gap_id", "query"], "left_anti").groupBy("gap_id", "search", "query").agg(F.min("o").alias("o"))
    most = F.when(F.col("search") == "counter", 1).otherwise(2)
    fresh = fresh.withColumn("place", F.row_number().over(Window.partitionBy("gap_id", "search").orderBy("o", "query")) - 1)
    return fresh.filter(F.col("place") < most).select("gap_id", "search", "place", "query")


Source = Callable[[DataFrame], "DataFrame | None"]


def search_sources(queries: DataFrame, sources: dict[str, Source], per_query: int = 10) -> tuple[DataFrame, list[str]]:
    """(hits, unavailable): what every source finds for the queries, ranked, ``per_query`` a query and source; sources that answer None are told.

    A source maps (gap_id, search, query) rows to (gap_id, search, query, rank, id, paper_id, title, text, year, doi).
    Hits without title and text are dropped; all searches of a gap are one pass over a source.
    """
    out, unavailable = None, []
    for name, find in sources.items():
        found = find(queries)
        if found is None:
            unavailable.append(name)
            continue
        found = found.filter((F.coalesce(F.trim("title"), F.lit("")) != "") | (F.coalesce(F.trim("text"), F.lit("")) != "")).filter(F.col("rank") <= per_query).withColumn("source", F.lit(name))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no source is available: " + ", ".join(unavailable))
    return out, unavailable


def items_by_words(gaps: DataFrame, items: DataFrame) -> DataFrame:
    """(gap_id, external): how many different items (word, id) have one of a gap's words (gap_id, word).

    Items are counted once for each set of words that gaps have, never paired with the gaps.
    """
    sets = gaps.groupBy("gap_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    words = sets.select("words").distinct().withColumn("word", F.explode("words"))
    single = words.filter(F.size("words") == 1).select("word", "words").join(items.groupBy("word").agg(F.count_distinct("id").alias("external")), "word").select("words", "external")
    several = words.filter(F.size("words") > 1).join(items, "word").groupBy("words").agg(F.count_distinct("id").alias("external"))
    return sets.join(single.unionByName(several), "words").select("gap_id", "external")


def adequacy(gaps: DataFrame, concept_papers: DataFrame, relevant: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """(gap_id, run_papers, external, adequacy): papers of the run that have all of a gap's concepts, else any, and its relevant external items.

    ``gaps``: (gap_id, run_id, core); ``concept_papers``: (run_id, entity, paper_id); ``relevant``: (gap_id, id) of external sources,
    or ``external``: (gap_id, external), these counted before.
    """
    need = gaps.select("gap_id", "run_id", F.size(F.array_distinct("core")).alias("k"), F.explode(F.array_distinct("core")).alias("entity"))
    p = need.join(concept_papers.select("run_id", "entity", "paper_id").distinct(), ["run_id", "entity"]).groupBy("gap_id", "k", "paper_id").agg(F.count("*").alias("n"))
    c = p.groupBy("gap_id").agg(F.sum((F.col("n") == F.col("k")).cast("int")).alias("every"), F.count("*").alias("any"))
    run = F.coalesce(F.when(F.col("every") > 0, F.col("every")).otherwise(F.col("any")), F.lit(0))
    e = relevant.groupBy("gap_id").agg(F.count_distinct("id").alias("external")) if external is None else external
    j = gaps.select("gap_id").join(c, "gap_id", "left").join(e, "gap_id", "left").select("gap_id", run.alias("run_papers"), F.coalesce("external", F.lit(0)).alias("external"))
    return j.withColumn("adequacy", F.round(0.5 * F.least(F.lit(1.0), F.col("run_papers") / 10) + 0.5 * F.least(F.lit(1.0), F.col("external") / 15), 4))


def to_refine(coverage: DataFrame, iteration: int, most: int = 3) -> DataFrame:
    """The gaps of (gap_id, relevant, retrieval, concept) whose search goes on after ``iteration`` rounds."""
    if iteration >= max(1, most):
        return coverage.limit(0)
    again = (F.col("relevant") < 5) | F.coalesce(F.col("retrieval") < 0.5, F.lit(False)) | F.coalesce(F.col("concept") < 1.0, F.lit(False))
    return coverage.filter(again)


def iterate(gaps: DataFrame, first: DataFrame, refine: Callable[[DataFrame, DataFrame], DataFrame], find: Callable[[DataFrame], DataFrame], assess: Callable[[DataFrame, DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(queries, hits, rounds): searches, assesses and refines all gaps side by side until none goes on; ``most`` rounds at most.

    ``first``: the queries of round one; ``find``: queries to hits; ``assess``: (queries, hits) to (gap_id, relevant,
    retrieval, concept); ``refine``: (gaps that go on, used queries) to further queries. Each round is written out.
    """
    from vellum.session import materialise

    asked = materialise(first, "queries")
    hits = materialise(find(asked), "hits")
    rounds = 1
    while rounds < max(1, most):
        on = materialise(to_refine(assess(asked, hits), rounds, most).select("gap_id"), "again")
        if on.isEmpty():
            break
        more = materialise(refine(gaps.join(on, "gap_id", "left_semi"), asked), "queries")
        if more.isEmpty():
            break
        found = materialise(find(more), "hits")
        asked, hits, rounds = asked.unionByName(more), hits.unionByName(found), rounds + 1
    return asked, hits, rounds


def batch(available: DataFrame, gap_ids: list[str] | None = None, limit: int = 10) -> DataFrame:
    """The candidates to validate: those asked for, each of which must be there, else the first ``limit`` by turns of their sources."""
    from vellum.operators.signals import interleaved

    if gap_ids is None:
        return interleaved(available, limit)
    wanted = sorted(set(gap_ids))
    chosen = available.filter(F.col("gap_id").isin(wanted))
    missing = set(wanted) - {r[0] for r in chosen.select("gap_id").distinct().collect()}  # at most those asked for
    if missing:
        raise LookupError("unknown gaps: " + ", ".join(sorted(missing)))
    return chosen


def outcome_summary(validated: DataFrame) -> DataFrame:
    """(run_id, verdict, n) of validated gaps."""
    return validated.groupBy("run_id", "verdict").agg(F.count("*").alias("n"))


def evidence_chain(gaps: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """(gap_id, step, label, summary): how a verdict came about, step by step.

    ``gaps``: (gap_id, statement, gap_score, support_mass, counter_mass, penalty, confidence, cap, verdict, reason);
    ``items``: (gap_id, search, evidence_type, strength); ``queries``: (gap_id, search, query).
    """
    one = gaps.select("gap_id", F.lit(0).alias("o"), F.lit("Candidate").alias("label"), F.format_string('"%s"; score %.2f.', F.substring("statement", 1, 160), F.col("gap_score").cast("double")).alias("summary"))
    found = items.groupBy("gap_id", "search").agg(F.count("*").alias("n"), F.sum((F.col("evidence_type") != "Insufficient").cast("int")).alias("r"))
    asked = queries.groupBy("gap_id", "search").agg(F.count_distinct("query").alias("q"))
    s = asked.join(found, ["gap_id", "search"], "left").na.fill(0, ["n", "r"])
    search = s.select("gap_id", F.lit(1).alias("o"), F.concat(F.initcap(F.replace("search", F.lit("_"), F.lit(" "))), F.lit(" search")).alias("label"), F.format_string("%d queries found %d items, %d relevant.", "q", "n", "r").alias("summary"))
    kinds = F.create_map(*[F.lit(x) for k, v in (("Counter", 2), ("Contradictory", 3), ("Partial", 4), ("Supporting", 5)) for x in (k, v)])
    e = items.filter(kinds[F.col("evidence_type")].isNotNull()).groupBy("gap_id", "evidence_type").agg(F.count("*").alias("n"), F.sum(F.col("strength").cast("double")).alias("s"))
    kind = e.select("gap_id", kinds[F.col("evidence_type")].alias("o"), F.concat("evidence_type", F.lit(" evidence")).alias("label"), F.format_string("%d items, strength %.2f.", "n", "s").alias("summary"))
    d = lambda c: F.col(c).cast("double")
    sure = gaps.select("gap_id", F.lit(6).alias("o"), F.lit("Confidence").alias("label"), F.format_string("support %.2f against %.2f; penalty %.2f; confidence %.2f%s.", d("support_mass"), d("counter_mass"), d("penalty"), d("confidence"), F.when(F.col("cap") != "", F.concat(F.lit(" capped: "), "cap")).otherwise("")).alias("summary"))
    end = gaps.select("gap_id", F.lit(7).alias("o"), F.lit("Classification").alias("label"), F.format_string("%s (%s).", "verdict", "reason").alias("summary"))
    rows = one.unionByName(search).unionByName(kind).unionByName(sure).unionByName(end)
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("gap_id").orderBy("o", "label"))).select("gap_id", "step", "label", "summary")


def attempt(rows: DataFrame, call: Callable[[Column], Column], prompt: str, schema: str) -> DataFrame:
    """Adds ``answer``: struct(ok, error, value) of a model's JSON answer to a prompt column; a failure is a value, not an exception.

    ``call`` maps the prompt to the answer's text (null: the provider failed). An answer that is no object of ``schema``
    is an error; key-like strings in errors are redacted.
    """
    from vellum.functions.text import redact

    t = rows.withColumn("_raw", call(F.col(prompt))).withColumn("_value", F.from_json("_raw", schema))
    shape = F.trim("_raw").startswith("{") & F.trim("_raw").endswith("}") & F.col("_value").isNotNull()
    error = F.when(F.col("_raw").isNull(), "PROVIDER_FAILED").when(~F.coalesce(shape, F.lit(False)), redact(F.concat(F.lit("NOT_AN_OBJECT: "), F.substring("_raw", 1, 200)), []))
    return t.withColumn("answer", F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), F.col("_value")).alias("value"))).drop("_raw", "_value")

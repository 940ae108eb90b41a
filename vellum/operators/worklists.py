"""Stages of a paper: worklists by status, results of a stage, resets, health and what contradicts the artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stages in order, with their status column, the status before, when done and when failed.
STAGES = [
    ("acquisition", "full_text_status", "NOT_CHECKED", "DOWNLOADED", "DOWNLOAD_FAILED"),
    ("parsing", "parsing_status", "NOT_PARSED", "PARSED", "PARSE_FAILED"),
    ("sectioning", "section_status", "NOT_EXTRACTED", "EXTRACTED", "EXTRACTION_FAILED"),
    ("chunking", "chunk_status", "NOT_CHUNKED", "CHUNKED", "CHUNK_FAILED"),
    ("representation", "embedding_status", "NOT_EMBEDDED", "EMBEDDED", "EMBEDDING_FAILED"),
]
# What a status says of an artifact: done implies that it is there, not parsed that it isn't.
ARTIFACTS = [("fulltext", "full_text_status", "DOWNLOADED", True), ("parsed", "parsing_status", "PARSED", True), ("parsed", "parsing_status", "NOT_PARSED", False), ("sections", "section_status", "EXTRACTED", True), ("chunks", "chunk_status", "CHUNKED", True)]
# The counts of the corpus' health.
HEALTH = [("downloaded", "full_text_status", "DOWNLOADED"), ("not_checked", "full_text_status", "NOT_CHECKED"), ("no_oa_found", "full_text_status", "NO_OA_FOUND"), ("download_failed", "full_text_status", "DOWNLOAD_FAILED"), ("invalid_document", "full_text_status", "INVALID_DOCUMENT"), ("parsed", "parsing_status", "PARSED"), ("sections_extracted", "section_status", "EXTRACTED"), ("chunked", "chunk_status", "CHUNKED")]
SORTS = ("downloaded", "year_desc", "year_asc", "title_asc", "title_desc")


def status(stage: str) -> Column:
    """A stage's status; a null one is the status before the stage."""
    column, before = next((c, b) for s, c, b, _, _ in STAGES if s == stage)
    return F.coalesce(F.col(column), F.lit(before))


def is_done(stage: str) -> Column:
    return status(stage) == next(d for s, _, _, d, _ in STAGES if s == stage)


def due(stage: str) -> Column:
    """Whether a paper waits for a stage. Chunked papers always do for representation, which skips what is embedded; failed ones are tried again, but for acquisition."""
    names = [s for s, *_ in STAGES]
    if stage == "acquisition":
        return status(stage) == "NOT_CHECKED"
    if stage in ("representation", "corpus"):
        return is_done("chunking")
    out = ~is_done(stage)
    for earlier in names[: names.index(stage)]:
        out = out & is_done(earlier)
    return out


def worklist(papers: DataFrame, sources: DataFrame, stage: str) -> DataFrame:
    """(run_id, stage, paper_id): the papers of each run that wait for a stage ("corpus": those that retrieval reads)."""
    runs = sources.select("run_id", "paper_id").distinct()
    return runs.join(papers.filter(due(stage)).select("paper_id"), "paper_id").select("run_id", F.lit(stage).alias("stage"), "paper_id")


def pending_acquisition(papers: DataFrame, limit: int = 100) -> DataFrame:
    """The newest papers whose full text was never looked for, ``limit`` at most; ties by paper_id."""
    return papers.filter(due("acquisition")).orderBy(F.desc("created_at"), "paper_id").limit(limit)


def run_listing(papers: DataFrame, sources: DataFrame, run_id: str, search: str | None = None, sort_by: str = "downloaded", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a run's papers with ``place`` and ``total``; ``search`` looks in title, DOI and abstract, whatever the case.

    An unknown ``sort_by`` is "downloaded": downloaded papers first, then the newest. Ties go by title and paper_id.
    """
    mine = papers.join(sources.filter(F.col("run_id") == run_id).select("paper_id").distinct(), "paper_id", "left_semi")
    if search:
        inside = F.lit(False)
        for c in ("title", "doi", "abstract"):
            inside = inside | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(search.lower()))
        mine = mine.filter(inside)
    year = [F.desc_nulls_last("publication_year"), F.asc("title")]
    orders = {"year_desc": year, "year_asc": [F.asc_nulls_last("publication_year"), F.asc("title")], "title_asc": [F.asc("title")], "title_desc": [F.desc("title")]}
    order = orders.get(sort_by, [F.when(is_done("acquisition"), 0).otherwise(1), *year])
    total = mine.agg(F.count("*").alias("total"))
    page = mine.orderBy(*order, "paper_id").offset(offset).limit(limit)
    place = F.row_number().over(Window.orderBy(*order, "paper_id"))  # of one page
    return page.withColumn("place", place).crossJoin(F.broadcast(total))  # one row


def health(papers: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The counts of papers by status: of each run, or of the whole corpus without ``sources``."""
    rows = papers if sources is None else papers.join(sources.select("run_id", "paper_id").distinct(), "paper_id")
    counts = [F.count_distinct(F.when(F.coalesce(c, F.lit("NOT_CHECKED") if c == "full_text_status" else F.lit("")) == v, F.col("paper_id"))).alias(n) for n, c, v in HEALTH]
    every = [F.count_distinct("paper_id").alias("total_papers"), *counts]
    return rows.agg(*every) if sources is None else rows.groupBy("run_id").agg(*every)


def inconsistencies(papers: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(paper_id, artifact, field, status, kind): where a status and the artifacts that are there contradict each other.

    ``artifacts``: (paper_id, artifact), one row or more for each that exists.
    """
    there = artifacts.select("paper_id", "artifact").distinct().withColumn("there", F.lit(True))
    default = {c: b for _, c, b, _, _ in STAGES}
    rules = F.array(*[F.when(F.coalesce(F.col(c), F.lit(default[c])) == v, F.struct(F.lit(a).alias("artifact"), F.lit(c).alias("field"), F.lit(v).alias("status"), F.lit(e).alias("expected"))) for a, c, v, e in ARTIFACTS])
    checks = papers.select("paper_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("paper_id", "r.*")
    j = checks.join(there, ["paper_id", "artifact"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    kind = F.when(F.col("expected"), "STATUS_SAYS_DONE_BUT_ARTIFACT_MISSING").otherwise("ARTIFACT_EXISTS_BUT_STATUS_NOT_UPDATED")
    return j.filter(F.col("expected") != F.col("there")).select("paper_id", "artifact", "field", "status", kind.alias("kind"))


def reset(papers: DataFrame, sources: DataFrame, run_id: str, stage: str = "sectioning") -> DataFrame:
    """Papers with the statuses from ``stage`` on set back, for a run's papers whose stage before is done."""
    names = [s for s, *_ in STAGES]
    if stage not in names[2:]:
        raise ValueError(f"cannot reset from {stage!r}")
    mine = sources.filter(F.col("run_id") == run_id).select("paper_id").distinct().withColumn("_mine", F.lit(True))
    hit = F.coalesce(F.col("_mine"), F.lit(False)) & is_done(names[names.index(stage) - 1])
    out = papers.join(mine, "paper_id", "left").withColumn("_hit", hit)
    for _, column, before, _, _ in STAGES[names.index(stage) :]:
        out = out.withColumn(column, F.when(F.col("_hit"), before).otherwise(F.col(column)))
    return out.drop("_mine", "_hit")


def finish(papers: DataFrame, results: DataFrame, stage: str) -> DataFrame:
    """Papers after a stage: done or failed where ``results`` (paper_id, ok) has a paper that was due; others keep their status.

    A paper of several results is done if one is; a null ``ok`` is a failure. Papers that were done stay done.
    """
    _, column, _, done, failed = next(x for x in STAGES if x[0] == stage)
    one = results.groupBy("paper_id").agg(F.max(F.coalesce("ok", F.lit(False)).cast("int")).alias("_ok"))
    out = papers.join(one, "paper_id", "left")
    return out.withColumn(column, F.when(F.col("_ok").isNotNull() & due(stage) & ~is_done(stage), F.when(F.col("_ok") == 1, done).otherwise(failed)).otherwise(F.col(column))).drop("_ok")


def prerequisites(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """(run_id, papers, chunked, represented, problem): why a run can't be searched or built upon; null if it can."""
    rows = papers.join(sources.select("run_id", "paper_id").distinct(), "paper_id")
    embedded = F.col("embedding_status").isin("EMBEDDED", "PARTIAL")
    g = rows.groupBy("run_id").agg(F.count("*").alias("papers"), F.sum(is_done("chunking").cast("int")).cast("long").alias("chunked"), F.sum(F.coalesce(is_done("chunking") & embedded, F.lit(False)).cast("int")).cast("long").alias("represented"))
    return g.withColumn("problem", F.when(F.col("chunked") == 0, "NOT_CHUNKED").when(F.col("represented") == 0, "NOT_REPRESENTED"))


def embedding_plan(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, action): EMBED what has text and no vector, SKIP what has one, BLANK, and DELETE vectors of chunks that are gone.

    ``chunks``: (paper_id, chunk_id, text); ``embedded``: (paper_id, chunk_id) of one model. Repeated rows count once.
    """
    have = chunks.groupBy("paper_id", "chunk_id").agg(F.max("text").alias("text"), F.lit(True).alias("is_chunk"))
    done = embedded.select("paper_id", "chunk_id").distinct().withColumn("is_done", F.lit(True))
    j = have.join(done, ["paper_id", "chunk_id"], "full_outer")
    action = F.when(F.col("is_chunk").isNull(), "DELETE").when(F.coalesce(F.trim("text"), F.lit("")) == "", "BLANK").when(F.col("is_done"), "SKIP").otherwise("EMBED")
    return j.select("paper_id", "chunk_id", action.alias("action"))


def embedding_status(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """(paper_id, embedding_status) after a run of ``plan`` in which the chunks of ``failed`` (chunk_id) got no vector."""
    bad = failed.select("chunk_id").distinct().withColumn("bad", F.lit(True))
    j = plan.filter("action in ('EMBED', 'SKIP')").join(bad, "chunk_id", "left")
    ok = F.sum((F.col("bad").isNull() | (F.col("action") == "SKIP")).cast("int"))
    g = j.groupBy("paper_id").agg(ok.alias("ok"), F.count("*").alias("n"))
    some = g.select("paper_id", F.when(F.col("ok") == F.col("n"), "EMBEDDED").when(F.col("ok") > 0, "PARTIAL").otherwise("EMBEDDING_FAILED").alias("embedding_status"))
    blank = plan.filter("action <> 'DELETE'").select("paper_id").distinct().join(some, "paper_id", "left_anti").select("paper_id", F.lit("EMBEDDED").alias("embedding_status"))
    return some.unionByName(blank)

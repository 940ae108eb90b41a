"""Stages of ingestion and streams: chunking, entity forms, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import graph as G
from vellum.operators import ingest as I
from vellum.operators import sections as SEC
from vellum.sources.tables import table
from vellum.streaming import incremental as X

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def chunker(spark, d):
    """Chunks of all sections by paper; a plan per section, not its text, is what others join on."""
    t = table(spark, d, "sections").dropDuplicates(["section_id"])
    c = SEC.chunk_sections(t.withColumnRenamed("normalized_title", "n"))
    return c.groupBy("section_type").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.count_distinct("paper_id").alias("papers"))


def section_bodies(spark, d):
    """Lines of documents under their headings: a line that begins with # is a heading."""
    t = table(spark, d, "documents").filter("text is not null")
    lines = t.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    lines = lines.withColumn("is_heading", F.col("text").startswith("#"))
    s = I.heading_sections(lines)
    return s.select("paper_id", "section", "heading", F.length("body").alias("size"))


def canonical_entities(spark, d):
    m = table(spark, d, "kg_mentions").filter("entity_id is not null")
    names = m.select(F.upper(F.trim(F.split("entity_id", ":")[0])).alias("type"), F.lower(F.trim(F.expr("substring(entity_id, instr(entity_id, ':') + 1)"))).alias("name"), "paper_id")
    e = names.groupBy("type", "name").agg(F.count_distinct("paper_id").alias("papers"))
    curated = table(spark, d, "kg_entities").select(F.col("entity_type").alias("type"), F.lower("name").alias("name")).distinct().withColumn("curated", F.lit(True))
    e = e.join(curated, ["type", "name"], "left")
    return G.canonical_forms(I.embed_hashed(e, "name")).groupBy("type").agg(F.count("*").alias("names"), F.count_distinct("canonical").alias("entities"))


def stream_incremental(spark, d):
    """Events taken as a stream of files, counted per hour, compared with the batch in SQL."""
    target, state = X.scratch(spark, "events"), X.scratch(spark, "state")
    got = X.run_available(spark, f"{d}/events.parquet*", EVENT_SCHEMA, lambda b: b.select("event_id", "ts", "event_type", "value"), target, state)
    return X.windowed_counts(got).groupBy("event_type").agg(F.count("*").alias("hours"), F.sum("n").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def event_sessions(spark, d):
    s = X.sessions(table(spark, d, "events").select("user_id", "ts"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def page_snippets(spark, d):
    t = table(spark, d, "sections").dropDuplicates(["section_id"]).filter("text is not null")
    return t.select("section_id", T.snippet(F.col("text"), 200).alias("snippet"), T.page_range(F.col("page_start"), F.col("page_end")).alias("pages"))


def statement_keywords(spark, d):
    t = table(spark, d, "test_items")
    return t.select("item_id", F.array_join(T.keywords(F.col("text"), T.STOP_WORDS, 6), " ").alias("keywords"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
QUERIES = {f.__name__: f for f in (chunker, section_bodies, canonical_entities, stream_incremental, event_sessions, page_snippets, statement_keywords)}
ORACLES = {
    "section_bodies": """WITH l AS (SELECT doc_id AS paper_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, starts_with(text, '#') AS h, sum(starts_with(text, '#')::INT) OVER (PARTITION BY paper_id ORDER BY i) AS section FROM l)
SELECT paper_id, section::BIGINT AS section, max(CASE WHEN h THEN text END) AS heading, coalesce(length(string_agg(text, chr(10) ORDER BY i) FILTER (NOT h)), 0)::INT AS size FROM s WHERE section > 0 GROUP BY ALL""",
    "stream_incremental": "SELECT event_type, count(*) AS hours, sum(n)::BIGINT AS n, round(sum(v), 4) AS value FROM (SELECT event_type, date_trunc('hour', ts), count(*) AS n, sum(value) AS v FROM events GROUP BY ALL) GROUP BY event_type",
    "event_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM n GROUP BY user_id""",
    "page_snippets": r"""SELECT section_id, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END AS snippet, CASE WHEN page_start IS NULL THEN NULL WHEN page_end IS NULL OR page_start = page_end THEN page_start::VARCHAR ELSE page_start || '-' || page_end END AS pages
 FROM (SELECT DISTINCT ON (section_id) *, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS t FROM sections WHERE text IS NOT NULL)""",
    "statement_keywords": f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}'), 1) AS i FROM test_items),
f AS (SELECT item_id, w, min(i) AS i FROM w WHERE w NOT IN ({STOP_SQL}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM f)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS keywords FROM r WHERE k <= 6 GROUP BY item_id""",
}

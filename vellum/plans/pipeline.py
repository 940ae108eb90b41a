"""Queries on papers in their stages and on providers' records, over statuses told from what the tables hold of each paper."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import worklists as W
from vellum.sources import providers as P
from vellum.sources.tables import newest, table

RUN_SQL = "(SELECT min(run_id) FROM kg_papers)"


def _sources(spark, d):
    return table(spark, d, "kg_papers").select("run_id", "paper_id").distinct()


def _papers(spark, d):
    """One row per paper: a full text is there if a document has text, sections and chunks likewise."""
    filled = lambda c: F.sum(F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)).cast("int"))
    kp = newest(table(spark, d, "kg_papers"), ["paper_id"], "built_at").select("paper_id", "title", "publication_year", F.col("built_at").alias("created_at"))
    dc = table(spark, d, "documents").filter("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("dn"), filled("text").alias("dt"), F.min("text").alias("abstract"))
    se = table(spark, d, "sections").groupBy("paper_id").agg(F.count("*").alias("sn"), filled("text").alias("st"))
    ch = table(spark, d, "kg_mentions").groupBy("paper_id").agg(F.count_distinct("chunk_id").alias("cn"))
    em = table(spark, d, "chunk_embeddings").filter("embedding_model = 'lumen-base-192' and embedding is not null").groupBy("paper_id").agg(F.count_distinct("chunk_id").alias("en"))
    j = kp.join(dc, "paper_id", "left").join(se, "paper_id", "left").join(ch, "paper_id", "left").join(em, "paper_id", "left")
    full = F.expr("case when dn is null and sn is null then 'NO_OA_FOUND' when dn is null then null when dt = 0 then 'INVALID_DOCUMENT' when dn - dt > dt then 'DOWNLOAD_FAILED' else 'DOWNLOADED' end")
    j = j.withColumn("full_text_status", full).withColumn("parsing_status", F.expr("case when sn is null then null when st = 0 then 'PARSE_FAILED' else 'PARSED' end"))
    j = j.withColumn("section_status", F.expr("case when st > 0 and dt > 0 then 'EXTRACTED' end")).withColumn("chunk_status", F.expr("case when st > 0 and dt > 0 and cn > 3 then 'CHUNKED' end"))
    j = j.withColumn("embedding_status", F.expr("case when en >= cn then 'EMBEDDED' when en > 0 then 'PARTIAL' end"))
    return j.select("paper_id", "title", "abstract", F.lit(None).cast("string").alias("doi"), "publication_year", "created_at", "full_text_status", "parsing_status", "section_status", "chunk_status", "embedding_status")


PAPERS_SQL = """src AS (SELECT DISTINCT run_id, paper_id FROM kg_papers),
kq AS (SELECT paper_id, title, publication_year, built_at AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY built_at DESC, title DESC, publication_year DESC NULLS LAST, relevance DESC NULLS LAST, on_topic DESC NULLS LAST, run_id DESC) AS rn FROM kg_papers) WHERE rn = 1),
dq AS (SELECT paper_id, count(*) AS dn, sum(coalesce(length(trim(text, ' ')) > 0, false)::INT) AS dt, min(text) AS abstract FROM documents WHERE paper_id IS NOT NULL GROUP BY 1), sq AS (SELECT paper_id, count(*) AS sn, sum(coalesce(length(trim(text, ' ')) > 0, false)::INT) AS st FROM sections GROUP BY 1),
cq AS (SELECT paper_id, count(DISTINCT chunk_id) AS cn FROM kg_mentions GROUP BY 1), eq AS (SELECT paper_id, count(DISTINCT chunk_id) AS en FROM chunk_embeddings WHERE embedding_model = 'lumen-base-192' AND embedding IS NOT NULL GROUP BY 1),
p AS (SELECT kq.*, abstract, CASE WHEN dn IS NULL AND sn IS NULL THEN 'NO_OA_FOUND' WHEN dn IS NULL THEN NULL WHEN dt = 0 THEN 'INVALID_DOCUMENT' WHEN dn - dt > dt THEN 'DOWNLOAD_FAILED' ELSE 'DOWNLOADED' END AS f, CASE WHEN sn IS NULL THEN NULL WHEN st = 0 THEN 'PARSE_FAILED' ELSE 'PARSED' END AS r,
 CASE WHEN st > 0 AND dt > 0 THEN 'EXTRACTED' END AS s, CASE WHEN st > 0 AND dt > 0 AND cn > 3 THEN 'CHUNKED' END AS c, CASE WHEN en >= cn THEN 'EMBEDDED' WHEN en > 0 THEN 'PARTIAL' END AS e
 FROM kq LEFT JOIN dq USING (paper_id) LEFT JOIN sq USING (paper_id) LEFT JOIN cq USING (paper_id) LEFT JOIN eq USING (paper_id))"""


def stage_worklists(spark, d):
    """What every run has still to do, stage by stage."""
    p, s = _papers(spark, d), _sources(spark, d)
    out = None
    for stage in [x[0] for x in W.STAGES] + ["corpus"]:
        part = W.worklist(p, s, stage)
        out = part if out is None else out.unionByName(part)
    return out


def acquisition_pending(spark, d):
    return W.pending_acquisition(_papers(spark, d)).select("paper_id", "created_at")


def run_listings(spark, d):
    """A page of a run's papers in each of the five orders."""
    p, s = _papers(spark, d), _sources(spark, d)
    run = s.agg(F.min("run_id")).first()[0] or ""
    out = None
    for sort in W.SORTS:
        part = W.run_listing(p, s, run, "learning" if sort == "downloaded" else "e", sort, 5, 2).select(F.lit(sort).alias("sort"), "place", "paper_id", "total")
        out = part if out is None else out.unionByName(part)
    return out


def corpus_health_runs(spark, d):
    return W.health(_papers(spark, d), _sources(spark, d))


def corpus_health_whole(spark, d):
    return W.health(_papers(spark, d))


def _artifacts(spark, d):
    part = lambda t, a: table(spark, d, t).filter("paper_id is not null").select("paper_id", F.lit(a).alias("artifact"))
    full = table(spark, d, "documents").filter("paper_id is not null and lang = 'en'").select("paper_id", F.lit("fulltext").alias("artifact"))  # others are lost
    return full.unionByName(part("sections", "parsed")).unionByName(part("sections", "sections")).unionByName(part("chunk_embeddings", "chunks"))


def status_inconsistencies(spark, d):
    return W.inconsistencies(_papers(spark, d), _artifacts(spark, d))


def stage_reset(spark, d):
    p, s = _papers(spark, d), _sources(spark, d)
    run = s.agg(F.min("run_id")).first()[0] or ""
    return W.reset(p, s, run, "chunking").groupBy("section_status", "chunk_status", "embedding_status").agg(F.count("*").alias("papers"))


def stage_results(spark, d):
    """Papers after sectioning in which those without any text fail."""
    docs = table(spark, d, "documents").filter("paper_id is not null").select("paper_id", (F.length(F.trim("text")) > 0).alias("ok"))
    out = W.finish(_papers(spark, d), docs, "sectioning")
    return out.groupBy("parsing_status", "section_status").agg(F.count("*").alias("papers"))


def run_prerequisites(spark, d):
    return W.prerequisites(_papers(spark, d), _sources(spark, d))


def _embedding_plan(spark, d):
    chunks = table(spark, d, "kg_mentions").select("paper_id", "chunk_id", F.col("entity_id").alias("text"))
    done = table(spark, d, "chunk_embeddings").filter("embedding_model = 'lumen-base-192' and embedding is not null").select("paper_id", "chunk_id")
    return W.embedding_plan(chunks, done)


def embedding_plan(spark, d):
    return _embedding_plan(spark, d).groupBy("paper_id", "action").agg(F.count("*").alias("chunks"))


def embedding_status(spark, d):
    """Statuses if the chunks whose id ends in an even digit get no vector."""
    plan = _embedding_plan(spark, d)
    return W.embedding_status(plan, plan.filter("chunk_id rlike '[02468]$'").select("chunk_id")).groupBy("embedding_status").agg(F.count("*").alias("papers"))


def _items(spark, d):
    t = table(spark, d, "external_items")
    return t.groupBy("source", "item_id").agg(F.max(F.struct("fetched_at", "result_rank", "source_query", "title", "abstract", "year", "doi", "url", "citations")).alias("i")).select("source", "item_id", "i.*")


def _openalex_bodies(spark, d):
    """Every OpenAlex item as the provider would answer, one JSON object a row."""
    i = _items(spark, d).filter("source = 'openalex'")
    words = i.filter("trim(abstract) <> ''").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("abstract", r"[ \t\r\n\f\x0B]+", " ")), " ")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    body = F.struct(
        F.concat(F.lit("https://openalex.org/"), "item_id").alias("id"), "title", F.array(F.struct(F.struct(F.col("source_query").alias("display_name")).alias("author"))).alias("authorships"), F.col("index").alias("abstract_inverted_index"), F.col("year").alias("publication_year"),
        F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status"), F.col("url").alias("oa_url")).alias("open_access"), F.col("citations").alias("cited_by_count"),
    )
    return i.join(index, "item_id", "left").select(F.to_json(body).alias("body"))


def openalex_records(spark, d):
    p = P.openalex_papers(_openalex_bodies(spark, d))
    return p.select("provider_id", "title", F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"), "publication_year", "doi", "paper_url", "full_text_url", "citation_count")


def semantic_scholar_records(spark, d):
    body = F.struct(
        F.col("item_id").alias("paperId"), "title", F.array(F.struct(F.col("source_query").alias("name"))).alias("authors"), "abstract", "year", F.lit("  ").alias("venue"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"),
        F.struct("url", F.lit("GREEN").alias("status")).alias("openAccessPdf"), F.col("citations").alias("citationCount"), "url",
    )
    p = P.semantic_scholar_papers(_items(spark, d).filter("source = 'semantic_scholar'").select(F.to_json(body).alias("body")))
    return p.select("provider_id", "title", F.array_join("authors", ";").alias("authors"), F.md5("abstract").alias("abstract"), "publication_year", "venue", "doi", "full_text_url", "open_access_status", "citation_count")


def full_text_discovery(spark, d):
    """Links of all items: their own, or the one that another item of their DOI has."""
    i = _items(spark, d)
    papers = i.select("item_id", "doi", F.when(F.col("source") == "openalex", F.col("url")).alias("full_text_url"), F.col("source").alias("source_type"))
    body = F.to_json(F.struct("doi", (F.col("citations") > 0).alias("is_oa"), F.struct(F.lit("").alias("url_for_pdf"), "url").alias("best_oa_location")))
    found = P.discovered(papers, i.filter("source = 'semantic_scholar' and doi is not null").select("doi", body.alias("body")))
    return found.groupBy("url_source").agg(F.count("*").alias("items"), F.count("best_url").alias("links"))


def download_statuses(spark, d):
    """Statuses of full texts, where a document's venue, language, section and length stand for link, answer, type and size."""
    kind = F.when(F.col("section_type") == "REFERENCES", "text/html").otherwise("application/pdf; v=1")
    t = table(spark, d, "documents").select("doc_id", P.download_status(F.col("venue"), F.when(F.col("lang").isNotNull(), 200).otherwise(404), kind, F.length("text") * 1000).alias("status"))
    return t.groupBy("status").agg(F.count("*").alias("papers"))


def artifact_paths(spark, d):
    t = table(spark, d, "kg_papers").select("paper_id", "on_topic").distinct()
    path = F.when(F.col("on_topic"), P.artifact_path(F.col("paper_id"), "parsed.json")).when(~F.col("on_topic"), F.concat(F.lit("papers/"), P.artifact_path(F.col("paper_id"), "chunks.json"))).otherwise(F.concat(F.lit("other/"), "paper_id", F.lit("/x")))
    return t.select(path.alias("path")).select("path", P.paper_of_path(F.col("path")).alias("paper_id"))


def point_lookup(spark, d):
    p = P.openalex_papers(_openalex_bodies(spark, d))
    first = p.agg(F.min("provider_id")).first()[0] or ""
    return P.point_lookup(p, first).select("provider_id", "title")


def abstract_with_repeats(spark, d):
    """Texts from maps in which every word also stands at the place before, so that places are shared."""
    t = table(spark, d, "test_items").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("p", "w"))
    index = t.groupBy("item_id", "w").agg(F.sort_array(F.flatten(F.collect_list(F.array("p", F.greatest(F.col("p") - 1, F.lit(0)))))).alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", P.inverted_index_with_repeats(F.col("index")).alias("text"))


def _newest_items(where: str = "") -> str:
    return f"""SELECT source, item_id, i.* FROM (SELECT source, item_id, max(struct_pack(fetched_at := fetched_at, result_rank := result_rank, source_query := source_query, title := title, abstract := abstract, year := year, doi := doi, url := url, citations := citations)) AS i FROM external_items {where} GROUP BY ALL)"""


QUERIES = {
    f.__name__: f
    for f in (
        stage_worklists, acquisition_pending, run_listings, corpus_health_runs, corpus_health_whole, status_inconsistencies, stage_reset, stage_results, run_prerequisites, embedding_plan, embedding_status,
        openalex_records, semantic_scholar_records, full_text_discovery, download_statuses, artifact_paths, point_lookup, abstract_with_repeats,
    )
}
_F, _R, _S, _C = "coalesce(f, 'NOT_CHECKED')", "coalesce(r, 'NOT_PARSED')", "coalesce(s, 'NOT_EXTRACTED')", "coalesce(c, 'NOT_CHUNKED')"
_HEALTH_SQL = f"""count(DISTINCT paper_id) AS total_papers, count(DISTINCT paper_id) FILTER ({_F} = 'DOWNLOADED') AS downloaded, count(DISTINCT paper_id) FILTER ({_F} = 'NOT_CHECKED') AS not_checked, count(DISTINCT paper_id) FILTER (f = 'NO_OA_FOUND') AS no_oa_found,
 count(DISTINCT paper_id) FILTER (f = 'DOWNLOAD_FAILED') AS download_failed, count(DISTINCT paper_id) FILTER (f = 'INVALID_DOCUMENT') AS invalid_document, count(DISTINCT paper_id) FILTER (r = 'PARSED') AS parsed,
 count(DISTINCT paper_id) FILTER (s = 'EXTRACTED') AS sections_extracted, count(DISTINCT paper_id) FILTER (c = 'CHUNKED') AS chunked"""
_PLAN_SQL = """h AS (SELECT paper_id, chunk_id, max(entity_id) AS text FROM kg_mentions GROUP BY ALL), e AS (SELECT DISTINCT paper_id, chunk_id, true AS done FROM chunk_embeddings WHERE embedding_model = 'lumen-base-192' AND embedding IS NOT NULL),
pl AS (SELECT paper_id, chunk_id, CASE WHEN h.text IS NULL THEN 'DELETE' WHEN trim(h.text, ' ') = '' THEN 'BLANK' WHEN done THEN 'SKIP' ELSE 'EMBED' END AS action FROM h FULL JOIN e USING (paper_id, chunk_id))"""
_ORDERS = {"downloaded": f"CASE WHEN {_F} = 'DOWNLOADED' THEN 0 ELSE 1 END, publication_year DESC NULLS LAST, title", "year_desc": "publication_year DESC NULLS LAST, title", "year_asc": "publication_year NULLS LAST, title", "title_asc": "title", "title_desc": "title DESC"}


def _listing_sql() -> str:
    parts = []
    for sort, order in _ORDERS.items():
        word = "learning" if sort == "downloaded" else "e"
        mine = f"(SELECT p.*, count(*) OVER () AS total, row_number() OVER (ORDER BY {order}, paper_id) AS n FROM p WHERE paper_id IN (SELECT paper_id FROM src WHERE run_id = {RUN_SQL}) AND (contains(lower(title), '{word}') OR contains(lower(coalesce(abstract, '')), '{word}')))"
        parts.append(f"SELECT '{sort}' AS sort, (n - 2)::INT AS place, paper_id, total FROM {mine} WHERE n BETWEEN 3 AND 7")
    return " UNION ALL ".join(parts)


ORACLES = {
    "stage_worklists": f"""WITH {PAPERS_SQL}, w AS (SELECT 'acquisition' AS stage, paper_id FROM p WHERE {_F} = 'NOT_CHECKED' UNION ALL SELECT 'parsing', paper_id FROM p WHERE f = 'DOWNLOADED' AND {_R} <> 'PARSED'
 UNION ALL SELECT 'sectioning', paper_id FROM p WHERE f = 'DOWNLOADED' AND r = 'PARSED' AND {_S} <> 'EXTRACTED' UNION ALL SELECT 'chunking', paper_id FROM p WHERE f = 'DOWNLOADED' AND r = 'PARSED' AND s = 'EXTRACTED' AND {_C} <> 'CHUNKED'
 UNION ALL SELECT 'representation', paper_id FROM p WHERE c = 'CHUNKED' UNION ALL SELECT 'corpus', paper_id FROM p WHERE c = 'CHUNKED') SELECT run_id, stage, paper_id FROM w JOIN src USING (paper_id)""",
    "acquisition_pending": f"WITH {PAPERS_SQL} SELECT paper_id, created_at FROM p WHERE {_F} = 'NOT_CHECKED' ORDER BY created_at DESC, paper_id LIMIT 100",
    "run_listings": f"WITH {PAPERS_SQL} {_listing_sql()}",
    "corpus_health_runs": f"WITH {PAPERS_SQL} SELECT run_id, {_HEALTH_SQL} FROM p JOIN src USING (paper_id) GROUP BY run_id",
    "corpus_health_whole": f"WITH {PAPERS_SQL} SELECT {_HEALTH_SQL} FROM p",
    "status_inconsistencies": f"""WITH {PAPERS_SQL}, a AS (SELECT DISTINCT paper_id, 'fulltext' AS artifact FROM documents WHERE lang = 'en' UNION SELECT paper_id, 'parsed' FROM sections UNION SELECT paper_id, 'sections' FROM sections UNION SELECT paper_id, 'chunks' FROM chunk_embeddings),
ck AS (SELECT paper_id, 'fulltext' AS artifact, 'full_text_status' AS field, 'DOWNLOADED' AS status, true AS want FROM p WHERE f = 'DOWNLOADED' UNION ALL SELECT paper_id, 'parsed', 'parsing_status', 'PARSED', true FROM p WHERE r = 'PARSED'
 UNION ALL SELECT paper_id, 'parsed', 'parsing_status', 'NOT_PARSED', false FROM p WHERE r IS NULL UNION ALL SELECT paper_id, 'sections', 'section_status', 'EXTRACTED', true FROM p WHERE s = 'EXTRACTED' UNION ALL SELECT paper_id, 'chunks', 'chunk_status', 'CHUNKED', true FROM p WHERE c = 'CHUNKED')
SELECT paper_id, artifact, field, status, CASE WHEN want THEN 'STATUS_SAYS_DONE_BUT_ARTIFACT_MISSING' ELSE 'ARTIFACT_EXISTS_BUT_STATUS_NOT_UPDATED' END AS kind FROM ck WHERE want <> ((paper_id, artifact) IN (SELECT (paper_id, artifact) FROM a WHERE paper_id IS NOT NULL))""",
    "stage_reset": f"""WITH {PAPERS_SQL}, h AS (SELECT *, s IS NOT DISTINCT FROM 'EXTRACTED' AND paper_id IN (SELECT paper_id FROM src WHERE run_id = {RUN_SQL}) AS hit FROM p)
SELECT s AS section_status, CASE WHEN hit THEN 'NOT_CHUNKED' ELSE c END AS chunk_status, CASE WHEN hit THEN 'NOT_EMBEDDED' ELSE e END AS embedding_status, count(*) AS papers FROM h GROUP BY ALL""",
    "stage_results": f"""WITH {PAPERS_SQL}, k AS (SELECT paper_id, max(coalesce(length(trim(text, ' ')) > 0, false)::INT) AS ok FROM documents WHERE paper_id IS NOT NULL GROUP BY 1)
SELECT r AS parsing_status, CASE WHEN ok IS NOT NULL AND f = 'DOWNLOADED' AND r = 'PARSED' AND {_S} <> 'EXTRACTED' THEN CASE WHEN ok = 1 THEN 'EXTRACTED' ELSE 'EXTRACTION_FAILED' END ELSE s END AS section_status, count(*) AS papers FROM p LEFT JOIN k USING (paper_id) GROUP BY ALL""",
    "run_prerequisites": f"""WITH {PAPERS_SQL}, g AS (SELECT run_id, count(*) AS papers, sum((c IS NOT DISTINCT FROM 'CHUNKED')::INT)::BIGINT AS chunked, sum((coalesce(c = 'CHUNKED' AND e IN ('EMBEDDED', 'PARTIAL'), false))::INT)::BIGINT AS represented FROM p JOIN src USING (paper_id) GROUP BY run_id)
SELECT *, CASE WHEN chunked = 0 THEN 'NOT_CHUNKED' WHEN represented = 0 THEN 'NOT_REPRESENTED' END AS problem FROM g""",
    "embedding_plan": f"WITH {_PLAN_SQL} SELECT paper_id, action, count(*) AS chunks FROM pl GROUP BY ALL",
    "embedding_status": f"""WITH {_PLAN_SQL}, g AS (SELECT paper_id, sum((action = 'SKIP' OR NOT regexp_matches(chunk_id, '[02468]$'))::INT) AS ok, count(*) AS n FROM pl WHERE action IN ('EMBED', 'SKIP') GROUP BY 1),
st AS (SELECT paper_id, CASE WHEN ok = n THEN 'EMBEDDED' WHEN ok > 0 THEN 'PARTIAL' ELSE 'EMBEDDING_FAILED' END AS s FROM g UNION ALL SELECT DISTINCT paper_id, 'EMBEDDED' FROM pl WHERE action <> 'DELETE' AND paper_id NOT IN (SELECT paper_id FROM g))
SELECT s AS embedding_status, count(*) AS papers FROM st GROUP BY 1""",
    "openalex_records": rf"""SELECT item_id AS provider_id, coalesce(nullif(trim(title, ' '), ''), '(No title)') AS title, trim(source_query, ' ') AS authors, md5(trim(regexp_replace(coalesce(abstract, ''), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ')) AS abstract, year AS publication_year, nullif(trim(doi, ' '), '') AS doi,
 'https://openalex.org/' || item_id AS paper_url, nullif(trim(url, ' '), '') AS full_text_url, citations::INT AS citation_count FROM ({_newest_items("WHERE source = 'openalex'")})""",
    "semantic_scholar_records": f"""SELECT item_id AS provider_id, coalesce(nullif(trim(title, ' '), ''), '(No title)') AS title, trim(source_query, ' ') AS authors, md5(trim(coalesce(abstract, ''), ' ')) AS abstract, year AS publication_year, NULL::VARCHAR AS venue, nullif(doi, '') AS doi,
 nullif(url, '') AS full_text_url, 'GREEN' AS open_access_status, citations::INT AS citation_count FROM ({_newest_items("WHERE source = 'semantic_scholar'")})""",
    "full_text_discovery": f"""WITH i AS ({_newest_items()}), u AS (SELECT DISTINCT doi FROM i WHERE source = 'semantic_scholar' AND doi IS NOT NULL AND citations > 0 AND url <> '')
SELECT CASE WHEN source = 'openalex' AND url <> '' THEN 'openalex' WHEN u.doi IS NOT NULL THEN 'unpaywall' END AS url_source, count(*) AS items, count(CASE WHEN (source = 'openalex' AND url <> '') OR u.doi IS NOT NULL THEN 1 END) AS links FROM i LEFT JOIN u USING (doi) GROUP BY 1""",
    "download_statuses": """SELECT CASE WHEN venue IS NULL THEN 'NO_OA_FOUND' WHEN lang IS NULL THEN 'DOWNLOAD_FAILED' WHEN section_type IS NOT DISTINCT FROM 'REFERENCES' OR text IS NULL OR length(text) = 0 OR length(text) * 1000 > 20971520 THEN 'INVALID_DOCUMENT' ELSE 'DOWNLOADED' END AS status, count(*) AS papers FROM documents GROUP BY 1""",
    "artifact_paths": """SELECT DISTINCT CASE WHEN on_topic THEN 'papers/' || paper_id || '/parsed.json' WHEN NOT on_topic THEN 'papers/papers/' || paper_id || '/chunks.json' ELSE 'other/' || paper_id || '/x' END AS path, CASE WHEN on_topic IS NOT NULL THEN paper_id END AS paper_id FROM kg_papers""",
    "point_lookup": f"SELECT item_id AS provider_id, coalesce(nullif(trim(title, ' '), ''), '(No title)') AS title FROM ({_newest_items("WHERE source = 'openalex'")}) ORDER BY item_id LIMIT 1",
    "abstract_with_repeats": r"""WITH w AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM test_items)),
b AS (SELECT item_id, w, p FROM w UNION ALL SELECT item_id, w, greatest(p - 1, 0) FROM w) SELECT item_id, string_agg(w, ' ' ORDER BY p, w) AS text FROM b GROUP BY item_id""",
}

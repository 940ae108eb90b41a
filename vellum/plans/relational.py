"""Relational queries over papers, provenance, sections and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import scores as S
from vellum.functions import text as T
from vellum.operators import ingest as I
from vellum.operators import neardup as N
from vellum.operators import sections as SEC
from vellum.plans.retrieval import NOISE_SQL
from vellum.session import materialise
from vellum.sources.tables import fresh, newest, table


def noise_filter(spark, d):
    t = table(spark, d, "documents")
    noise = T.is_noise(F.col("section_type"), F.col("text"))
    return t.groupBy("section_type").agg(F.count("*").alias("rows"), F.sum(noise.cast("int")).alias("noise"))


def citation_density(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", F.round(T.citation_density(F.col("text")), 6).alias("density"), T.word_count(F.col("text")).alias("words")).filter("density > 0")


def section_preset_filter(spark, d):
    t = table(spark, d, "documents").filter(F.col("section_type").isin(T.section_set(["gap_evidence"])))
    return t.groupBy("section_type", "lang").agg(F.count("*").alias("n"))


def year_range_filter(spark, d):
    return table(spark, d, "documents").filter("publication_year between 2018 and 2022").select("doc_id", "publication_year", "venue")


def paged_listing(spark, d):
    t = table(spark, d, "external_items").filter(F.col("title").ilike("%learning%"))
    rows = newest(t, ["item_id"], "fetched_at").select("item_id", "title", "year")
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc_nulls_last("year"), "item_id").offset(10).limit(20)
    return page.crossJoin(F.broadcast(total))  # one row


def pending_worklist_anti(spark, d):
    chunks = table(spark, d, "kg_mentions").select("chunk_id", "paper_id").distinct()
    done = table(spark, d, "chunk_embeddings").filter("embedding is not null and embedding_model = 'lumen-base-192'").select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti").groupBy("paper_id").agg(F.count("*").alias("pending"))


def stale_vector_anti(spark, d):
    kept = table(spark, d, "kg_mentions").select("chunk_id")
    return table(spark, d, "chunk_embeddings").select("chunk_id", "paper_id").distinct().join(kept, "chunk_id", "left_anti")


def provenance_semi(spark, d):
    topic = newest(table(spark, d, "kg_papers"), ["run_id", "paper_id"], "built_at").filter("on_topic")
    return table(spark, d, "documents").select("doc_id", "paper_id", "section_type").join(topic.select("paper_id"), "paper_id", "left_semi")


def provenance_left(spark, d):
    papers = newest(table(spark, d, "kg_papers"), ["run_id", "paper_id"], "built_at")
    docs = table(spark, d, "documents").filter("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("docs"))
    return papers.join(docs, "paper_id", "left").groupBy("run_id").agg(F.count("*").alias("papers"), F.sum(F.coalesce("docs", F.lit(0))).alias("docs"))


def corpus_health_counts(spark, d):
    t = table(spark, d, "documents")
    status = F.when(F.col("text").isNull(), "MISSING").when(F.trim("text") == "", "BLANK").when(F.length("text") < 100, "SHORT").otherwise("PARSED")
    s = t.select("doc_id", "paper_id", "venue", status.alias("status"))
    return s.agg(*[F.count_distinct(F.when(F.col("status") == x, F.col("doc_id"))).alias(x.lower()) for x in ("MISSING", "BLANK", "SHORT", "PARSED")], F.count_distinct("paper_id").alias("papers"), F.count_distinct("venue").alias("venues"))


def runs_paper_counts(spark, d):
    return table(spark, d, "kg_papers").groupBy("run_id").agg(F.count_distinct("paper_id").alias("papers"), F.count("*").alias("rows"), F.max("built_at").alias("last_built"))


def multi_source_having(spark, d):
    t = table(spark, d, "external_items").select(T.doi_key(F.col("doi")).alias("doi_key"), "source", "item_id")
    return t.filter("doi_key is not null").groupBy("doi_key").agg(F.count_distinct("source").alias("sources"), F.count_distinct("item_id").alias("items")).filter("sources > 1")


def section_type_counts(spark, d):
    t = table(spark, d, "sections").dropDuplicates(["section_id"])
    return t.groupBy("section_type").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.round(F.avg("heading_confidence"), 6).alias("confidence"))


def weighted_mean_null_skip(spark, d):
    t = newest(table(spark, d, "kg_papers"), ["run_id", "paper_id"], "built_at").withColumn("publication_year", F.expr("nullif(publication_year, 0)"))
    values = {"relevance": F.col("relevance"), "recency": S.recency(F.col("publication_year"), F.lit(2024)), "topic": F.col("on_topic").cast("double")}
    return t.select("run_id", "paper_id", F.round(S.weighted_mean(values, {"relevance": 0.35, "recency": 0.15, "topic": 0.5}), 6).alias("score"))


def status_artifact_full_outer(spark, d):
    a = table(spark, d, "documents").filter("paper_id is not null").groupBy("paper_id").agg(F.count("*").alias("docs"))
    b = table(spark, d, "sections").groupBy("paper_id").agg(F.count_distinct("section_id").alias("sections"))
    j = a.join(b, "paper_id", "full_outer")
    state = F.when(F.col("docs").isNull(), "NO_DOCUMENT").when(F.col("sections").isNull(), "NOT_SECTIONED").otherwise("OK")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("papers"))


def doi_normalise(spark, d):
    t = table(spark, d, "external_items")
    return t.select("item_id", T.doi_key(F.col("doi")).alias("doi_key")).distinct()


def title_author_year_key(spark, d):
    t = table(spark, d, "external_items")
    key = T.title_key(F.col("title"), F.array().cast("array<string>"), F.col("year"))
    return t.select("item_id", key.alias("key")).filter("key is not null").distinct()


def upsert_by_doi(spark, d):
    return I.upsert_by_doi(table(spark, d, "external_items"), F.col("fetched_at"))


def _items(spark, d):
    t = table(spark, d, "external_items")
    one = t.groupBy("item_id").agg(F.max("title").alias("title"), F.max("year").alias("year"), F.max(T.doi_key(F.col("doi"))).alias("doi"), F.max("abstract").alias("abstract"))
    return one.withColumn("authors", F.array().cast("array<string>"))


def exact_dedup_components(spark, d):
    return I.deduplicate(_items(spark, d), "item_id").select("item_id", "canonical")


def dedup_merged_fields(spark, d):
    return I.merge_fields(I.deduplicate(_items(spark, d), "item_id"), ["title", "year", "abstract"], "item_id")


def newest_mentions(spark, d):
    t = newest(table(spark, d, "kg_mentions").select("run_id", "chunk_id", "entity_id", "mention_count", "tagged_at"), ["run_id", "chunk_id", "entity_id"], "tagged_at")
    return t.filter("mention_count >= 1").groupBy("run_id").agg(F.count("*").alias("mentions"), F.sum("mention_count").cast("long").alias("total"))


def collection_caps(spark, d):
    t = I.collection_caps(table(spark, d, "external_items").distinct(), 5, 200, F.col("fetched_at"))
    return t.select("source", "source_query", "item_id", "result_rank", "place")


def distinct_case_insensitive(spark, d):
    t = table(spark, d, "external_items").select(F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))).alias("key"), "title").filter("title <> ''")
    return t.groupBy("key").agg(F.min("title").alias("title"), F.count("*").alias("rows"))


def id_set_except(spark, d):
    a = table(spark, d, "chunk_embeddings").select("paper_id")
    b = table(spark, d, "sections").select("paper_id")
    return a.subtract(b).withColumn("side", F.lit("vectors_only")).unionByName(b.subtract(a).withColumn("side", F.lit("sections_only")))


def sentence_split_counts(spark, d):
    t = table(spark, d, "documents").filter("text is not null and text rlike '[^\\\\s]'")
    return t.select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def chunk_diagnostics(spark, d):
    t = table(spark, d, "sections").dropDuplicates(["section_id"]).filter("text is not null")
    size = T.approx_tokens(F.col("text"))
    return t.groupBy("section_type").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg(size), 6).alias("mean"))


def _from_inverted_index(t):
    words = t.select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"[ \t\r\n\f\x0B]+", " ")), " ")).alias("p", "w"))
    index = words.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", F.md5(T.inverted_index_text(F.col("index"))).alias("digest"))


def abstract_from_inverted_index(spark, d):
    return _from_inverted_index(table(spark, d, "documents").filter("length(text) > 0"))


def heading_normalise(spark, d):
    t = table(spark, d, "sections").filter("title is not null").select("title").distinct()
    return t.select("title", T.heading(F.col("title")).alias("heading"))


def section_classify(spark, d):
    t = table(spark, d, "sections").select("normalized_title").distinct()
    return t.select("normalized_title", T.section_type(F.col("normalized_title")).alias("kind"))


def parent_section(spark, d):
    return SEC.parent_sections(table(spark, d, "sections").dropDuplicates(["section_id"])).filter("parent is not null").select("section_id", "parent")


def statement_jaccard_neardup(spark, d):
    """Classes of all items by their titles' terms: pairs of classes with a Jaccard of 0.8 or more, and each item's class.

    Items of equal terms are one class, which stands by its least item.
    """
    t = _items(spark, d).select(F.col("item_id").alias("id"), F.array_sort(T.statement_terms(F.coalesce("title", F.lit("")))).alias("terms")).filter(F.size("terms") > 0)
    t = materialise(t.join(t.groupBy("terms").agg(F.min("id").alias("class")), "terms"), "statements")
    heads = t.filter("id = class").select("id", "terms")
    pairs = N.near_sets(heads, heads, 0.8, True)
    return pairs.select(F.col("a").alias("item_id"), F.col("b").alias("item_b"), "jaccard").unionByName(t.select(F.col("class").alias("item_id"), F.col("id").alias("item_b"), F.lit(1.0).alias("jaccard")))


def job_event_status(spark, d):
    t = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").cast("long").alias("k"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("value"))


def latest_job_state(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r"))
    return t.groupBy(F.col("r.event_type").alias("state")).agg(F.count("*").alias("jobs"))


def cache_ttl(spark, d):
    t = fresh(table(spark, d, "external_items"), "2024-01-01 00:00:00", 30)
    return t.filter("fetched_at <= timestamp '2024-01-01 00:00:00'").groupBy("source").agg(F.count("*").alias("entries"), F.count_distinct("source_query").alias("queries"))


def counts_by_year(spark, d):
    t = table(spark, d, "documents").filter(T.contains_all(F.col("text"), ["gene expression"]) & F.col("publication_year").isNotNull())
    return t.groupBy("publication_year").agg(F.count("*").alias("n"))


def top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    t = table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    return t.select("o_custkey", "o_orderkey", "rn")


def region_revenue(spark, d):
    li, o, c, n, r = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


ITEMS_SQL = r"""dk AS (SELECT *, nullif(trim(regexp_replace(regexp_replace(trim(lower(doi)), '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', '')), '') AS dkey FROM external_items),
it AS (SELECT * FROM (SELECT item_id, max(title) AS title, max(year) AS year, max(dkey) AS doi, max(abstract) AS abstract FROM dk GROUP BY item_id)
),
tk AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS tt FROM it)"""
ITEMS_WHOLE_SQL = ITEMS_SQL
COMPONENTS_SQL = f"""WITH RECURSIVE {ITEMS_SQL},
keys AS (SELECT item_id, 'd:' || doi AS key FROM tk WHERE doi IS NOT NULL UNION ALL SELECT item_id, 't:' || tt || '||' || year FROM tk WHERE tt <> '' AND year <> 0),
e AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM keys a JOIN keys b USING (key)),
reach(a, b) AS (SELECT item_id, item_id FROM it UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
comp AS (SELECT a AS item_id, min(b) AS canonical FROM reach GROUP BY a)"""
KG_NEWEST = "kp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY run_id, paper_id ORDER BY built_at DESC, title DESC, publication_year DESC NULLS LAST, relevance DESC NULLS LAST, on_topic DESC NULLS LAST) AS rn FROM kg_papers) WHERE rn = 1)"


def _classify_sql() -> str:
    case = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for p, k in T.SECTION_RULES)
    return f"SELECT DISTINCT normalized_title, CASE WHEN coalesce(t, '') = '' THEN 'UNKNOWN' {case} ELSE 'OTHER' END AS kind FROM (SELECT normalized_title, lower(trim(normalized_title)) AS t FROM sections)"


LOWER_SQL = ", ".join(f"'{w}'" for w in T.HEADING_LOWER)
STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
QUERIES = {
    f.__name__: f
    for f in (
        noise_filter, citation_density, section_preset_filter, year_range_filter, paged_listing, pending_worklist_anti, stale_vector_anti, provenance_semi, provenance_left,
        corpus_health_counts, runs_paper_counts, multi_source_having, section_type_counts, weighted_mean_null_skip, status_artifact_full_outer, doi_normalise, title_author_year_key,
        upsert_by_doi, exact_dedup_components, dedup_merged_fields, newest_mentions, collection_caps, distinct_case_insensitive, id_set_except, sentence_split_counts, chunk_diagnostics,
        abstract_from_inverted_index, heading_normalise, section_classify, parent_section, statement_jaccard_neardup, job_event_status, latest_job_state, cache_ttl, counts_by_year,
        top_per_group, region_revenue,
       
    )
}
ORACLES = {
    "noise_filter": f"SELECT section_type, count(*) AS rows, sum(CASE WHEN {NOISE_SQL} THEN 1 ELSE 0 END)::BIGINT AS noise FROM documents GROUP BY section_type",
    "citation_density": rf"""SELECT * FROM (SELECT doc_id, round(100.0 * (len(regexp_extract_all(text, '{T.CITATION_MARK}')) + 2 * len(regexp_extract_all(text, '{T.REFERENCE_ENTRY.replace("'", "''")}'))) / greatest(1, len(regexp_extract_all(text, '\S+'))), 6) AS density,
 len(regexp_extract_all(text, '\S+')) AS words FROM documents WHERE text IS NOT NULL) WHERE density > 0""",
    "section_preset_filter": "SELECT section_type, lang, count(*) AS n FROM documents WHERE section_type IN ('LIMITATIONS','FUTURE_WORK','DISCUSSION','CONCLUSION','RESULTS') GROUP BY ALL",
    "year_range_filter": "SELECT doc_id, publication_year, venue FROM documents WHERE publication_year BETWEEN 2018 AND 2022",
    "paged_listing": """WITH r AS (SELECT item_id, arg_max(title, fetched_at) AS title, arg_max(year, fetched_at) AS y0 FROM external_items WHERE title ILIKE '%learning%' GROUP BY item_id),
n AS (SELECT item_id, title, year FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY fetched_at DESC) AS rn FROM external_items WHERE title ILIKE '%learning%') WHERE rn = 1)
SELECT item_id, title, year, (SELECT count(*) FROM n) AS total FROM n ORDER BY year DESC NULLS LAST, item_id LIMIT 20 OFFSET 10""",
    "pending_worklist_anti": "SELECT paper_id, count(*) AS pending FROM (SELECT DISTINCT chunk_id, paper_id FROM kg_mentions) m WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.chunk_id = m.chunk_id AND embedding IS NOT NULL AND embedding_model = 'lumen-base-192') GROUP BY paper_id",
    "stale_vector_anti": "SELECT DISTINCT chunk_id, paper_id FROM chunk_embeddings e WHERE NOT EXISTS (SELECT 1 FROM kg_mentions m WHERE m.chunk_id = e.chunk_id)",
    "provenance_semi": f"WITH {KG_NEWEST} SELECT doc_id, paper_id, section_type FROM documents WHERE paper_id IN (SELECT paper_id FROM kp WHERE on_topic)",
    "provenance_left": f"WITH {KG_NEWEST}, dc AS (SELECT paper_id, count(*) AS docs FROM documents GROUP BY paper_id) SELECT run_id, count(*) AS papers, sum(coalesce(docs, 0))::BIGINT AS docs FROM kp LEFT JOIN dc USING (paper_id) GROUP BY run_id",
    "corpus_health_counts": """WITH s AS (SELECT *, CASE WHEN text IS NULL THEN 'MISSING' WHEN trim(text, ' ') = '' THEN 'BLANK' WHEN length(text) < 100 THEN 'SHORT' ELSE 'PARSED' END AS status FROM documents)
SELECT count(DISTINCT doc_id) FILTER (status = 'MISSING') AS missing, count(DISTINCT doc_id) FILTER (status = 'BLANK') AS blank, count(DISTINCT doc_id) FILTER (status = 'SHORT') AS short, count(DISTINCT doc_id) FILTER (status = 'PARSED') AS parsed,
 count(DISTINCT paper_id) AS papers, count(DISTINCT venue) AS venues FROM s""",
    "runs_paper_counts": "SELECT run_id, count(DISTINCT paper_id) AS papers, count(*) AS rows, max(built_at) AS last_built FROM kg_papers GROUP BY run_id",
    "multi_source_having": f"WITH {ITEMS_SQL} SELECT dkey AS doi_key, count(DISTINCT source) AS sources, count(DISTINCT item_id) AS items FROM dk WHERE dkey IS NOT NULL GROUP BY dkey HAVING count(DISTINCT source) > 1",
    "section_type_counts": "SELECT section_type, count(*) AS n, count(DISTINCT paper_id) AS papers, round(avg(heading_confidence), 6) AS confidence FROM (SELECT DISTINCT ON (section_id) * FROM sections) GROUP BY section_type",
    "weighted_mean_null_skip": f"""WITH {KG_NEWEST}, v AS (SELECT run_id, paper_id, relevance AS a, greatest(0.0, 1.0 - greatest(0, 2024 - nullif(publication_year, 0)) / 10.0) AS b0, nullif(publication_year, 0) AS y, on_topic::INT::DOUBLE AS c FROM kp),
w AS (SELECT *, CASE WHEN y IS NULL THEN NULL ELSE b0 END AS b FROM v)
SELECT run_id, paper_id, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 0 ELSE (coalesce(a * 0.35, 0) + coalesce(b * 0.15, 0) + coalesce(c * 0.5, 0)) /
 ((CASE WHEN a IS NULL THEN 0 ELSE 0.35 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.15 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.5 END)) END, 6) AS score FROM w""",
    "status_artifact_full_outer": """WITH a AS (SELECT paper_id, count(*) AS docs FROM documents WHERE paper_id IS NOT NULL GROUP BY 1), b AS (SELECT paper_id, count(*) AS sections FROM sections GROUP BY 1)
SELECT CASE WHEN docs IS NULL THEN 'NO_DOCUMENT' WHEN sections IS NULL THEN 'NOT_SECTIONED' ELSE 'OK' END AS state, count(*) AS papers FROM a FULL JOIN b USING (paper_id) GROUP BY 1""",
    "doi_normalise": f"WITH {ITEMS_SQL} SELECT DISTINCT item_id, dkey AS doi_key FROM dk",
    "title_author_year_key": rf"""SELECT DISTINCT item_id, t || '||' || year AS key FROM (SELECT item_id, year, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t
 FROM external_items) WHERE t <> '' AND year <> 0""",
    "upsert_by_doi": f"""WITH {ITEMS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY fetched_at DESC, item_id DESC, title DESC NULLS LAST) AS nt,
 row_number() OVER (PARTITION BY dkey ORDER BY abstract IS NULL OR abstract = '', fetched_at, item_id, abstract) AS oa, row_number() OVER (PARTITION BY dkey ORDER BY year IS NULL, fetched_at, item_id, year) AS oy FROM dk WHERE dkey IS NOT NULL)
SELECT dkey AS doi_key, max(CASE WHEN nt = 1 THEN title END) AS title, max(CASE WHEN oa = 1 THEN nullif(abstract, '') END) AS abstract, max(CASE WHEN oy = 1 THEN year END) AS year, count(*) AS rows FROM o GROUP BY dkey
UNION ALL SELECT NULL, title, nullif(abstract, ''), year, 1 FROM dk WHERE dkey IS NULL""",
    "exact_dedup_components": COMPONENTS_SQL + " SELECT item_id, canonical FROM comp",
    "dedup_merged_fields": COMPONENTS_SQL
    + """ SELECT canonical, max(CASE WHEN item_id = canonical THEN title END) AS title, arg_min(year, item_id) FILTER (year <> 0) AS year, arg_min(abstract, item_id) FILTER (abstract <> '' AND abstract <> '0') AS abstract, count(*) AS members
FROM comp JOIN it USING (item_id) GROUP BY canonical""",
    "newest_mentions": "SELECT run_id, count(*) AS mentions, sum(c)::BIGINT AS total FROM (SELECT run_id, max(struct_pack(t := tagged_at, c := mention_count)).c AS c FROM kg_mentions GROUP BY run_id, chunk_id, entity_id) WHERE c >= 1 GROUP BY run_id",
    "collection_caps": """WITH u AS (SELECT DISTINCT * FROM external_items), k AS (SELECT *, row_number() OVER (PARTITION BY source_query, source ORDER BY result_rank, item_id, fetched_at) AS n FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, fetched_at, source_query) AS place FROM k WHERE n <= 5) SELECT source, source_query, item_id, result_rank, place FROM t WHERE place <= 200""",
    "distinct_case_insensitive": r"SELECT lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS key, min(title) AS title, count(*) AS rows FROM external_items WHERE title <> '' GROUP BY 1",
    "id_set_except": """SELECT paper_id, 'vectors_only' AS side FROM (SELECT paper_id FROM chunk_embeddings EXCEPT SELECT paper_id FROM sections)
UNION ALL SELECT paper_id, 'sections_only' FROM (SELECT paper_id FROM sections EXCEPT SELECT paper_id FROM chunk_embeddings)""",
    "sentence_split_counts": r"""SELECT doc_id, (len(regexp_extract_all(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '[.!?][ ]+[A-Z"''(\[]')) + 1)::INT AS sentences FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \t\n\r\f\x0B]')""",
    "chunk_diagnostics": "SELECT section_type, count(*) AS n, min(s) AS least, max(s) AS most, round(avg(s), 6) AS mean FROM (SELECT DISTINCT ON (section_id) section_type, greatest(1, length(text) // 4)::INT AS s, text FROM sections) WHERE text IS NOT NULL GROUP BY section_type",
    "abstract_from_inverted_index": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g'))) AS digest FROM documents WHERE length(text) > 0",
    "heading_normalise": rf"""WITH t AS (SELECT DISTINCT title, trim(title) AS t FROM sections WHERE title IS NOT NULL),
b AS (SELECT title, CASE WHEN regexp_matches(t, '^\d{{1,3}}(?:\.\d{{1,3}}){{0,4}}\.?\s+') THEN trim(regexp_replace(t, '^\d{{1,3}}(?:\.\d{{1,3}}){{0,4}}\.?\s+', ''))
 WHEN regexp_matches(t, '(?i)^(?:I{{1,4}}|IV|VI{{0,4}}|IX|X{{1,4}}|XL|L|XC|C)\.?\s+') THEN trim(regexp_replace(t, '(?i)^(?:I{{1,4}}|IV|VI{{0,4}}|IX|X{{1,4}}|XL|L|XC|C)\.?\s+', '')) ELSE trim(regexp_replace(t, '^[A-Z]\.?\s+', '')) END AS t FROM t)
SELECT title, array_to_string(list_transform(regexp_split_to_array(t, '\s+'), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({LOWER_SQL}) THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS heading FROM b""",
    "section_classify": _classify_sql(),
    "parent_section": """WITH s AS (SELECT DISTINCT ON (section_id) section_id, paper_id, section_order, section_level FROM sections)
SELECT a.section_id, arg_max(b.section_id, struct_pack(o := b.section_order, i := b.section_id)) AS parent FROM s a JOIN s b ON a.paper_id = b.paper_id AND b.section_order < a.section_order AND b.section_level < a.section_level GROUP BY a.section_id""",
    "statement_jaccard_neardup": rf"""WITH {ITEMS_SQL}, m AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w NOT IN ({STOP_SQL})))) AS t FROM it),
c AS (SELECT item_id, t, min(item_id) OVER (PARTITION BY t) AS cl FROM m WHERE len(t) > 0), h AS (SELECT * FROM c WHERE item_id = cl),
j AS (SELECT a.item_id, b.item_id AS item_b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS la, len(b.t) AS lb FROM h a JOIN h b ON a.item_id < b.item_id)
SELECT item_id, item_b, round(i / (la + lb - i)::DOUBLE, 6) AS jaccard FROM j WHERE round(i / (la + lb - i)::DOUBLE, 6) >= 0.8 UNION ALL SELECT cl, item_id, 1.0 FROM c""",
    "job_event_status": "SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY event_type",
    "latest_job_state": "SELECT t AS state, count(*) AS jobs FROM (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS t FROM events GROUP BY user_id) GROUP BY t",
    "cache_ttl": "SELECT source, count(*) AS entries, count(DISTINCT source_query) AS queries FROM external_items WHERE fetched_at > TIMESTAMP '2024-01-01' - INTERVAL 30 DAY AND fetched_at <= TIMESTAMP '2024-01-01' GROUP BY source",
    "counts_by_year": "SELECT publication_year, count(*) AS n FROM documents WHERE contains(lower(text), 'gene expression') AND publication_year IS NOT NULL GROUP BY 1",
    "top_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "region_revenue": """SELECT r_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}

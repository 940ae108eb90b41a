"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import retrieval as R
from vellum.operators import search as H
from vellum.sources.tables import newest, table

ASKED = {
    "q1": "gene expression in microbial soil bacteria",
    "q2": "credit markets and household savings, household savings",
    "q3": "detector noise of dark matter halos",
    "q4": "gradient descent for few-shot reward models",
    "q5": "la formación docente y la fluidez lectora",
}


def _sql_terms() -> str:
    rows = []
    for q, text in ASKED.items():
        for w in re.findall(r"[^\W]+(?:-[^\W]+)*", text.lower()):
            if w not in T.STOP_WORDS:
                rows.append(f"('{q}','{w}')")
    return ", ".join(rows)


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
BM25_SQL = rf"""
WITH tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}'), lambda w: w NOT IN ({STOP_SQL})) AS t FROM documents),
sz AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf, avgdl FROM df, sz),
q AS (SELECT qid AS query_id, term, count(*) AS qtf FROM (VALUES {_sql_terms()}) v(qid, term) GROUP BY ALL),
w AS (SELECT query_id, q.term, qtf, avgdl, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM q JOIN raw USING (term)),
tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, len(t), term),
s AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN w USING (term) GROUP BY ALL HAVING score > 0),
scores AS (SELECT query_id, doc_id, round(score, 6) AS score FROM s),
overlap AS (SELECT query_id, doc_id, round(count(DISTINCT term) / (SELECT count(*) FROM q q2 WHERE q2.query_id = q.query_id)::DOUBLE, 6) AS score FROM tf JOIN q USING (term) GROUP BY query_id, doc_id),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM overlap)
"""


def _bm25(spark, d):
    return R.bm25(table(spark, d, "documents").select("doc_id", "text"), ASKED).withColumn("score", F.round("score", 6))


def _overlap(spark, d):
    """A second ranking: the share of a query's words that a document has."""
    terms = R.query_terms(ASKED, spark)
    total = terms.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = [r["term"] for r in terms.select("term").distinct().collect()]
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: w.isin(wanted)))).alias("term"))
    hits = docs.join(F.broadcast(terms), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(F.broadcast(total), "query_id").select("query_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("score"))


def bm25_topk(spark, d):
    return R.ranked(_bm25(spark, d), k=20)


def bm25_capped(spark, d):
    papers = table(spark, d, "documents").select("doc_id", "paper_id")
    rows = R.ranked(_bm25(spark, d)).join(papers, "doc_id")
    return R.cap_per_paper(rows, 1, 10).select("query_id", "doc_id", "score", "rank")


def bm25_filtered(spark, d):
    meta = table(spark, d, "documents").select("doc_id", "section_type", "text", "publication_year")
    rows = R.ranked(_bm25(spark, d)).join(meta, "doc_id")
    kept = rows.filter(R.keep(F.col("section_type"), F.col("text"), F.col("publication_year"), ["gap_evidence"], (2015, None)))
    return R.ranked(kept.select("query_id", "doc_id", "score"), k=20)


def rrf_overlap(spark, d):
    """Fusion of two sparse rankings."""
    lists = [("overlap", R.ranked(_overlap(spark, d), k=40)), ("sparse", R.ranked(_bm25(spark, d), k=40))]
    fused = R.rrf(lists).withColumn("score", F.round("score", 9))
    return R.ranked(fused, k=20)


def dense_texts(spark, d):
    return H.dense(table(spark, d, "documents").select("doc_id", "text"), ASKED, H.term_embedder(VOCABULARY), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def rrf_hybrid(spark, d):
    """Dense and sparse rankings of all documents, fused, with what each contributed."""
    h = H.hybrid(table(spark, d, "documents").select("doc_id", "text"), ASKED, H.term_embedder(VOCABULARY))
    parts = F.array_join(F.transform("contributors", lambda c: F.concat_ws(":", c["method"], c["rank"].cast("string"))), "+")
    return h.select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank", parts.alias("parts"))


def multi_query_rrf(spark, d):
    meta = table(spark, d, "documents").select("doc_id", "publication_year")
    rows = R.ranked(_bm25(spark, d)).join(meta, "doc_id").filter("publication_year >= 2015")
    fused = H.fused_queries(rows)
    return fused.orderBy(F.desc("score"), "seen", "doc_id").limit(50).select("doc_id", F.round("score", 9).alias("score"), "best_query", "best_rank", F.size("query_ranks").alias("queries"))


def best_of_queries(spark, d):
    return H.best_of_queries(R.ranked(_bm25(spark, d), k=60), 40)


def bm25_index_search(spark, d):
    """From a kept index; documents without text are in it too."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = H.build_index(docs)
    return H.search_index(index, ASKED, 20).crossJoin(spark.createDataFrame([(H.is_stale(index, docs), H.is_stale(index, docs.filter("text is not null")))], "stale boolean, stale_without_null boolean"))


def run_corpus(spark, d):
    kp = newest(table(spark, d, "kg_papers"), ["paper_id"], "built_at").select("paper_id", "title", "publication_year")
    chunks = table(spark, d, "kg_mentions").select("chunk_id", "paper_id", F.col("entity_id").alias("text"), F.lit("OTHER").alias("section_type"))
    c = H.run_corpus(kp, chunks, table(spark, d, "chunk_embeddings").filter("embedding is not null").select("chunk_id", "embedding"))
    return c.groupBy("paper_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"), F.min("text").alias("first"))


def capped_reranked(spark, d):
    """One document per paper after reranking, filled up and kept in the order of the reranking."""
    docs = table(spark, d, "documents").select("doc_id", "paper_id", "n_chars")
    rows = R.ranked(_bm25(spark, d), k=60).join(docs, "doc_id")
    again = H.rerank(rows, F.log(1.0 + F.coalesce("n_chars", F.lit(0))), 20)
    return R.cap_per_paper(again, 1, 50, reranked=True).select("query_id", "doc_id", "retrieval_rank", "rank")


def rerank_window(spark, d):
    rows = R.ranked(_bm25(spark, d), k=30).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    out = R.rerank_window(rows, -F.coalesce("n_chars", F.lit(0)).cast("double"), n=10)
    return out.select("query_id", "doc_id", "rank", "new_rank")


def _qrels(spark, d):
    """Grades from labels: the number of annotators who gave a document the query's subject, at most 2."""
    subject = {"q1": "biology", "q2": "economics", "q3": "physics", "q4": "machine_learning", "q5": "education"}
    of = F.create_map(*[F.lit(x) for q, s in subject.items() for x in (s, q)])
    labels = table(spark, d, "subject_labels").select("doc_id", of[F.lower("subject")].alias("query_id"), "annotator")
    return labels.filter(F.col("query_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.least(F.count_distinct("annotator"), F.lit(2)).alias("grade"))


def ir_metrics(spark, d):
    m = R.ir_metrics(R.ranked(_bm25(spark, d), k=100).select("query_id", "doc_id", "rank"), _qrels(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("p5", "p10", "r10", "rr", "ap", "ndcg10")], "judged10", "unjudged10")


def ir_metrics_macro(spark, d):
    m = ir_metrics(spark, d)
    return m.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p5", "p10", "r10", "rr", "ap", "ndcg10")], F.sum("judged10").alias("judged10"), F.sum("unjudged10").alias("unjudged10"))


def dense_topk(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = R.dense_top_k(rows, rows.filter("vec_id % 100 = 0"), 10)
    return near.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def dense_filtered(spark, d):
    """Filtered after ranking: of the 50 nearest those of the query's own label, ranked anew."""
    t = table(spark, d, "embeddings")
    near = R.dense_top_k(t.select("vec_id", "embedding"), t.filter("vec_id % 100 = 0").select("vec_id", "embedding"), 50)
    own = F.broadcast(t.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")))
    kept = near.join(t.select("vec_id", "label"), "vec_id").join(own, "query_id").filter("label = own")
    again = kept.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return again.filter("n <= 5").select("query_id", "vec_id", "n")


VOCABULARY = "gene expression microbial soil bacteria credit markets household savings detector noise dark matter halos gradient descent shot reward models formaci docente fluidez lectora".split()
_Q = ", ".join(f"('{k}', '{v}')" for k, v in ASKED.items())
_V = ", ".join(f"'{w}'" for w in VOCABULARY)
_W = "regexp_extract_all(lower(coalesce({}, '')), '[a-z]+')"
TEXT_DENSE_SQL = f"""dq AS (SELECT query_id, list_append(list_transform([{_V}], lambda v: len(list_filter({_W.format("q")}, lambda w: w = v))::DOUBLE), 0.05::DOUBLE) AS qv FROM (VALUES {_Q}) x(query_id, q)),
dv AS (SELECT doc_id, list_append(list_transform([{_V}], lambda v: len(list_filter({_W.format("text")}, lambda w: w = v))::DOUBLE), 0.05::DOUBLE) AS v FROM documents WHERE trim(text, ' ') <> ''),
ds AS (SELECT query_id, doc_id, round(list_cosine_similarity(v, qv), 9) AS score FROM dv, dq), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""
DENSE_SQL = """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s, q.label AS own, e.label
           FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
"""
NOISE_SQL = rf"""(coalesce(section_type, '') IN ('REFERENCES', 'ACKNOWLEDGMENTS') OR coalesce(len(regexp_extract_all(text, '\S+')), 0) = 0
 OR 100.0 * (len(regexp_extract_all(text, '{T.CITATION_MARK}')) + 2 * len(regexp_extract_all(text, '{T.REFERENCE_ENTRY.replace("'", "''")}'))) / greatest(1, len(regexp_extract_all(text, '\S+'))) >= 6.0
 OR (len(regexp_extract_all(text, '{T.BOILERPLATE}')) >= 3 AND len(regexp_extract_all(text, '{T.BOILERPLATE}')) * 12 >= len(regexp_extract_all(text, '\S+'))))"""
QRELS_SQL = """qrels AS (SELECT query_id, doc_id, least(count(DISTINCT annotator), 2) AS grade FROM subject_labels
 JOIN (VALUES ('q1','biology'),('q2','economics'),('q3','physics'),('q4','machine_learning'),('q5','education')) v(query_id, s) ON lower(subject) = s GROUP BY ALL),
j AS (SELECT r.query_id, r.doc_id, rank, grade, CASE WHEN coalesce(grade, 0) > 0 THEN 1 ELSE 0 END AS rel FROM r1 r LEFT JOIN qrels USING (query_id, doc_id) WHERE rank <= 100),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
per AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS rel5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS rel10, max(CASE WHEN rel = 1 THEN 1.0 / rank END) AS rr,
 sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) AS precs, sum(CASE WHEN rank <= 10 THEN (pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
 sum(CASE WHEN rank <= 10 AND grade IS NOT NULL THEN 1 ELSE 0 END) AS judged10, sum(CASE WHEN rank <= 10 AND grade IS NULL THEN 1 ELSE 0 END) AS unjudged10 FROM h GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrels) GROUP BY query_id),
m AS (SELECT query_id, round(coalesce(rel5 / 5.0, 0), 6) AS p5, round(coalesce(rel10 / 10.0, 0), 6) AS p10, round(coalesce(rel10 / relevant, 0), 6) AS r10, round(coalesce(rr, 0), 6) AS rr,
 round(coalesce(precs / relevant, 0), 6) AS ap, round(coalesce(dcg / idcg, 0), 6) AS ndcg10, coalesce(judged10, 0) AS judged10, coalesce(unjudged10, 0) AS unjudged10 FROM ideal LEFT JOIN per USING (query_id))"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_capped, bm25_filtered, rrf_overlap, dense_texts, rrf_hybrid, multi_query_rrf, best_of_queries, bm25_index_search, run_corpus, capped_reranked, rerank_window, ir_metrics, ir_metrics_macro, dense_topk, dense_filtered)}
ORACLES = {
    "bm25_topk": BM25_SQL + "SELECT query_id, doc_id, score, rank FROM r1 WHERE rank <= 20",
    "bm25_capped": BM25_SQL
    + """, c AS (SELECT r1.*, row_number() OVER (PARTITION BY query_id, coalesce(paper_id, '~' || doc_id) ORDER BY rank) > 1 AS over_cap FROM r1 JOIN documents USING (doc_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over_cap, rank) AS n FROM c)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM k WHERE n <= 10""",
    "bm25_filtered": BM25_SQL
    + f""", f AS (SELECT r1.query_id, doc_id, score FROM r1 JOIN documents USING (doc_id) WHERE section_type IN ('LIMITATIONS','FUTURE_WORK','DISCUSSION','CONCLUSION','RESULTS')
 AND publication_year >= 2015 AND NOT {NOISE_SQL}), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT query_id, doc_id, score, rank FROM x WHERE rank <= 20""",
    "rrf_overlap": BM25_SQL
    + """, u AS (SELECT query_id, doc_id, rank, 'sparse' AS method FROM r1 WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank, 'overlap' FROM r2 WHERE rank <= 40),
g AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(DISTINCT method, '+' ORDER BY method) AS methods FROM u GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g)
SELECT query_id, doc_id, score, methods, rank FROM x WHERE rank <= 20""",
    "dense_texts": f"WITH {TEXT_DENSE_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dr WHERE rank <= 20",
    "rrf_hybrid": BM25_SQL.rstrip() + f""", {TEXT_DENSE_SQL}, u AS (SELECT query_id, doc_id, rank, 1 AS l, 'dense' AS m FROM dr WHERE rank <= 40 UNION ALL SELECT query_id, doc_id, rank, 2, 'sparse' FROM r1 WHERE rank <= 40),
g AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, string_agg(m || ':' || rank, '+' ORDER BY l) AS parts FROM u GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g)
SELECT query_id, doc_id, round(score, 9) AS score, rank, parts FROM x WHERE rank <= 20""",
    "multi_query_rrf": BM25_SQL
    + """, f AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r1 JOIN documents USING (doc_id) WHERE publication_year >= 2015),
g AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, arg_min(query_id, struct_pack(r := rank, q := query_id)) AS best_query, min(rank) AS best_rank, min(struct_pack(q := query_id, r := rank)) AS seen, count(*)::INT AS queries FROM f GROUP BY doc_id)
SELECT doc_id, round(score, 9) AS score, best_query, best_rank, queries FROM g ORDER BY g.score DESC, seen, doc_id LIMIT 50""",
    "best_of_queries": BM25_SQL + ", b AS (SELECT doc_id, min(struct_pack(r := rank, q := query_id)) AS b FROM r1 WHERE rank <= 60 GROUP BY doc_id) SELECT doc_id, row_number() OVER (ORDER BY b, doc_id) AS place FROM b ORDER BY b, doc_id LIMIT 40",
    "bm25_index_search": BM25_SQL + "SELECT query_id, doc_id, score, rank, false AS stale, (SELECT count(*) > 0 FROM documents WHERE text IS NULL) AS stale_without_null FROM r1 WHERE rank <= 20",
    "run_corpus": """WITH c AS (SELECT chunk_id, min(struct_pack(p := paper_id, t := entity_id)) AS c FROM kg_mentions WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT c.p AS paper_id, count(*) AS chunks, count(CASE WHEN chunk_id IN (SELECT chunk_id FROM chunk_embeddings WHERE embedding IS NOT NULL) THEN 1 END) AS vectors, min(c.t) AS first FROM c WHERE c.p IN (SELECT paper_id FROM kg_papers) GROUP BY 1""",
    "capped_reranked": BM25_SQL + """, t AS (SELECT r1.query_id, doc_id, r1.rank, paper_id, n_chars FROM r1 JOIN documents USING (doc_id) WHERE rank <= 60), a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank > 20, CASE WHEN rank <= 20 THEN -ln(1 + coalesce(n_chars, 0)) END, rank) AS nr FROM t),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(paper_id, '~' || doc_id) ORDER BY nr) > 1 AS o FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, nr) AS n FROM c)
SELECT query_id, doc_id, rank AS retrieval_rank, row_number() OVER (PARTITION BY query_id ORDER BY nr) AS rank FROM k WHERE n <= 50""",
    "rerank_window": BM25_SQL
    + """SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank > 10, CASE WHEN rank <= 10 THEN coalesce(n_chars, 0) END, rank) AS new_rank
FROM r1 JOIN documents USING (doc_id) WHERE rank <= 30""",
    "ir_metrics": BM25_SQL + ", " + QRELS_SQL + " SELECT * FROM m",
    "ir_metrics_macro": BM25_SQL
    + ", "
    + QRELS_SQL
    + " SELECT round(avg(p5),6) AS p5, round(avg(p10),6) AS p10, round(avg(r10),6) AS r10, round(avg(rr),6) AS rr, round(avg(ap),6) AS ap, round(avg(ndcg10),6) AS ndcg10, sum(judged10)::BIGINT AS judged10, sum(unjudged10)::BIGINT AS unjudged10 FROM m",
    "dense_topk": DENSE_SQL + "SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10",
    "dense_filtered": DENSE_SQL + ", f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE rank <= 50 AND label = own) SELECT query_id, vec_id, n FROM f WHERE n <= 5",
}

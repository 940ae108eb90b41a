"""Search with a dense leg: pluggable embeddings, a kept BM25 index, hybrid fusion, reranking and checked arguments."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.scores import cosine
from vellum.functions.text import tokens
from vellum.operators import retrieval as R
from vellum.session import materialise

METHODS = ("dense", "sparse", "hybrid")
PER_LIST = 40  # of each list that is fused, as a hybrid of twenty results asks
Embedder = Callable[[Column], Column]


def checked(queries: dict[str, str], method: str = "hybrid", top_k: int = 10) -> dict[str, str]:
    """The queries, trimmed, each once, blank ones left out; raises for what can't be searched."""
    kept: dict[str, str] = {}
    for name, q in queries.items():
        if q and q.strip() and q.strip() not in kept.values():
            kept[name] = q.strip()
    if not kept:
        raise ValueError("at least one query that isn't blank is needed")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise ValueError("top_k must be from 1 to 100")
    return kept


def term_embedder(vocabulary: list[str], floor: float = 0.05) -> Embedder:
    """An embedder in the JVM: how often each word of a small vocabulary occurs, and a constant, so that no vector is zero."""

    def embed(text: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(vocabulary))
        # An array of one, so that the words are found once and not for each word of the vocabulary.
        counts = F.get(F.transform(F.array(words), lambda ws: F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.size(F.filter(ws, lambda w: w == v)).cast("double"))), F.lit(0))
        return F.concat(counts, F.array(F.lit(floor)))

    return embed


def dense(docs: DataFrame, queries: dict[str, str], embed: Embedder, k: int = PER_LIST, doc: str = "doc_id", text: str = "text", stored: str | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the ``k`` texts of the highest cosine for each of a few queries, ties by document.

    ``stored``: a column of vectors that were made before; a text without one is embedded here. Blank texts without a
    vector take no part. Each task hands on its best ``k`` of a query only.
    """
    q = docs.sparkSession.createDataFrame(list(checked(queries).items()), "query_id string, q string").select("query_id", embed(F.col("q")).alias("qv"))  # the stated queries
    own = F.when(F.trim(text) != "", embed(F.col(text)))
    rows = docs.select(doc, (F.coalesce(F.col(stored).cast("array<double>"), own) if stored else own).alias("v")).filter("v is not null")
    scored = rows.crossJoin(F.broadcast(q)).select("query_id", doc, F.round(cosine(F.col("v"), F.col("qv")), 9).alias("score"))
    return R.ranked(scored, doc=doc, k=k)


def fuse(lists: list[tuple[str, DataFrame]], k: int = R.RRF_K, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion with its parts: (by, doc, score, rank, contributors), of which each names method, rank and score.

    The contributors stand in the order of ``lists``; empty lists add nothing. Ties go to the smaller document.
    """
    rows = None
    for n, (name, df) in enumerate(lists):
        part = df.select(by, doc, F.struct(F.lit(n).alias("list"), F.lit(name).alias("method"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")).alias("c"))
        rows = part if rows is None else rows.unionByName(part)
    one = rows.groupBy(by, doc).agg(F.sum(1.0 / (k + F.col("c.rank"))).alias("score"), F.array_sort(F.collect_list("c")).alias("c"))
    parts = F.transform("c", lambda c: F.struct(c["method"].alias("method"), c["rank"].alias("rank"), c["score"].alias("score")))
    return R.ranked(one.select(by, doc, F.round("score", 12).alias("score"), parts.alias("contributors")), by, doc)


def hybrid(docs: DataFrame, queries: dict[str, str], embed: Embedder, k: int = 20, per_list: int = PER_LIST, third: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query by fusion of the dense, the sparse and, where given, a ``third`` ranking (query_id, doc, score, rank)."""
    # Rounded, so that scores that differ by the order of their sums tie.
    sparse = R.ranked(R.bm25(docs, queries, doc, text).withColumn("score", F.round("score", 6)), doc=doc, k=per_list)
    lists = [("dense", dense(docs, queries, embed, per_list, doc, text)), ("sparse", sparse)] + ([("third", third.filter(F.col("rank") <= per_list))] if third is not None else [])
    return fuse(lists, doc=doc).filter(F.col("rank") <= k)


def fused_queries(ranked: DataFrame, k: int = R.RRF_K, doc: str = "doc_id") -> DataFrame:
    """(doc, score, best_query, best_rank, query_ranks): fusion over queries after filtering, ranks counted anew.

    Equal scores keep the order in which documents were first seen: by query, then rank. ``query_ranks`` maps each
    query that found the document to its rank there.
    """
    again = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", doc)))
    one = again.groupBy(doc).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min_by("query_id", F.struct("rank", "query_id")).alias("best_query"), F.min("rank").alias("best_rank"),
        F.min(F.struct("query_id", "rank")).alias("seen"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_id", "rank")))).alias("query_ranks"),
    )
    return one


def best_of_queries(ranked: DataFrame, limit: int, doc: str = "doc_id") -> DataFrame:
    """(doc, place): documents by the best rank that any query gave them, ties by query; the first ``limit``."""
    best = ranked.groupBy(doc).agg(F.min(F.struct("rank", "query_id")).alias("b"))
    return best.orderBy("b", doc).limit(limit).withColumn("place", F.row_number().over(Window.orderBy("b", doc))).select(doc, "place")  # of ``limit`` rows


def rerank(rows: DataFrame, score: Column, n: int = 50, by: str = "query_id", fail_open: bool = False) -> DataFrame:
    """Rows with the first ``n`` ranks sorted anew by a scorer's column; ties and the tail keep their order.

    Adds ``retrieval_rank`` and ``reranker_score`` (null in the tail). A score that is null or not finite fails the query;
    with ``fail_open`` such a query keeps its order instead.
    """
    inside = F.col("rank") <= n
    s = rows.withColumn("reranker_score", F.when(inside, score.cast("double")))
    bad = inside & (F.col("reranker_score").isNull() | F.isnan("reranker_score") | (F.abs("reranker_score") == float("inf")))
    if fail_open:
        s = s.withColumn("_bad", F.max(bad).over(Window.partitionBy(by)))
        s = s.withColumn("reranker_score", F.when(~F.col("_bad"), F.col("reranker_score"))).drop("_bad")
    else:
        s = s.withColumn("reranker_score", F.when(bad, F.raise_error(F.lit("the scorer gave no finite score")).cast("double")).otherwise(F.col("reranker_score")))
    order = [F.when(inside, 0).otherwise(1), F.desc_nulls_last("reranker_score"), F.col("rank")]
    return s.withColumn("retrieval_rank", F.col("rank")).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


@dataclass
class Index:
    """A kept BM25 index: postings (term, doc_id, tf), lengths (doc_id, dl), terms (term, idf); any number of searches read it."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str | None = None) -> Index:
    """Tokenises a corpus once and writes the index; to ``folder`` where it shall outlive the session. Null texts are empty documents."""
    write = (lambda df, name: materialise(df, name)) if folder is None else (lambda df, name: _kept(df, f"{folder}/{name}"))
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    lengths = write(rows.select("doc_id", F.size("t").alias("dl")), "lengths")
    postings = write(rows.select("doc_id", F.explode("t").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")), "postings")
    size = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    raw = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # size: one row
    mean = raw.agg(F.avg("idf").alias("mean"))
    idf = F.when(F.col("idf") < 0, R.EPSILON * F.col("mean")).otherwise(F.col("idf"))
    return Index(postings, lengths, write(raw.crossJoin(F.broadcast(mean)).select("term", "avgdl", idf.alias("idf")), "terms"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_index(spark, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "terms")))


def is_stale(index: Index, docs: DataFrame, doc: str = "doc_id") -> bool:
    """Whether the corpus has other documents than the index."""
    a, b = index.lengths.select("doc_id"), docs.select(F.col(doc).alias("doc_id"))
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def search_index(index: Index, queries: dict[str, str], k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by BM25; only the postings of the queries' words are read on."""
    asked = R.query_terms(queries, index.terms.sparkSession)
    weights = F.broadcast(asked.join(index.terms, "term"))  # one row per word of a query
    hits = index.postings.join(weights, "term").join(index.lengths, "doc_id")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("dl") / F.col("avgdl")))
    return R.ranked(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0"), k=k)


class CorpusCache:
    """Tables of runs that are kept for a while: built at the first use, again after ``ttl`` seconds or ``clear``."""

    def __init__(self, ttl: float = 900, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, key, build: Callable[[], DataFrame]) -> DataFrame:
        at, df = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.ttl:
            df = materialise(build(), "corpus")
            self.held[key] = (self.clock(), df)
        return df

    def clear(self, key=None) -> None:
        self.held.clear() if key is None else self.held.pop(key, None)


def run_corpus(papers: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, paper_id, text, section_type, title, publication_year, embedding): the chunks of known papers, of repeated ids the first, with vectors where there are.

    ``papers``: (paper_id, title, publication_year); ``chunks``: (chunk_id, paper_id, text, section_type); ``vectors``: (chunk_id, embedding), those of unknown chunks left out.
    """
    one = chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("paper_id", "text", "section_type")).alias("c")).select("chunk_id", "c.*")
    p = papers.groupBy("paper_id").agg(F.min(F.struct("title", "publication_year")).alias("p")).select("paper_id", "p.*")
    v = vectors.groupBy("chunk_id").agg(F.min("embedding").alias("embedding"))
    return one.join(p, "paper_id").join(v, "chunk_id", "left").select("chunk_id", "paper_id", "text", "section_type", "title", "publication_year", "embedding")

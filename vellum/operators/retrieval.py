"""Ranking passages: BM25, vectors, rank fusion, caps and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import is_noise, section_set, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
BLOCK_QUERIES = 4096


def query_terms(queries: dict[str, str], spark: SparkSession) -> DataFrame:
    """(query_id, term, qtf): words of each query with their repetitions. At most the queries' words."""
    text = spark.createDataFrame(list(queries.items()), "query_id string, q string")
    return text.select("query_id", F.explode(tokens(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25(docs: DataFrame, queries: dict[str, str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc, score) of the documents that score above 0.

    Statistics are over all documents, whatever is filtered later. Only the
    words of the queries are exploded for scoring; the words of all documents
    meet once, as partial counts, for the frequencies. Null texts are empty
    documents. A word in more than half of the documents has the idf of a
    quarter of the mean.
    """
    spark = docs.sparkSession
    terms = query_terms(queries, spark)
    rows = docs.select(doc, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    size = rows.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = rows.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    wanted = [r["term"] for r in terms.select("term").distinct().collect()]  # words of the stated queries
    idf = raw.filter(F.col("term").isin(wanted)).crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    weights = F.broadcast(terms.join(idf, "term"))  # one row per word of a query
    hits = rows.select(doc, F.size("t").alias("dl"), F.explode(F.filter("t", lambda w: w.isin(wanted))).alias("term"))
    tf = hits.groupBy(doc, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(weights, "term").groupBy("query_id", doc).agg(F.sum(part).alias("score")).filter("score > 0")


def ranked(scores: DataFrame, by: str = "query_id", doc: str = "doc_id", k: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by descending score, ties by document; keeps the first ``k``."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), doc)))
    return out if k is None else out.filter(F.col("rank") <= k)


def cap_per_paper(rows: DataFrame, cap: int, k: int, paper: str = "paper_id", by: str = "query_id", doc: str = "doc_id", reranked: bool = False) -> DataFrame:
    """The first ``k`` by rank with at most ``cap`` of a paper; filled up with the best of the rest, then ranked by score, or by rank if ``reranked``.

    Rows without a paper aren't capped together; a ``cap`` of 0 is none.
    """
    if cap <= 0:
        return rows.filter(F.col("rank") <= k)
    owner = F.coalesce(F.col(paper).cast("string"), F.concat(F.lit("\u0000"), F.col(doc).cast("string")))
    w = Window.partitionBy(by, owner).orderBy("rank")
    first = rows.withColumn("over", (F.row_number().over(w) > cap).cast("int"))
    kept = first.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("over", "rank"))).filter(F.col("n") <= k)
    if reranked:
        return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).drop("over", "n")
    return ranked(kept.drop("over", "n", "rank"), by, doc)


def rrf(lists: list[tuple[str, DataFrame]], k: int = RRF_K, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of (by, doc, rank) lists: score, and the methods that contribute, by name."""
    rows = None
    for name, df in lists:
        part = df.select(by, doc, "rank", F.lit(name).alias("method"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(by, doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))


def multi_query(rows: DataFrame, k: int = RRF_K, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(doc, score, best_query, best_rank): fusion over queries after filtering; ranks count the rows that are left."""
    again = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank")))
    return again.groupBy(doc).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min_by(by, F.struct("rank", by)).alias("best_query"), F.min("rank").alias("best_rank"))


def keep(section: Column, text: Column, year: Column, sections: list[str] | None = None, years: tuple[int | None, int | None] = (None, None), noise: bool = False) -> Column:
    """Filter of retrieved rows: no noise, wanted sections, years within bounds (an unknown year fails a bound)."""
    out = F.lit(True) if noise else ~is_noise(section, text)
    if sections:
        out = out & F.coalesce(section.isin(section_set(sections)), F.lit(False))
    for bound, test in ((years[0], year >= F.lit(years[0] or 0)), (years[1], year <= F.lit(years[1] or 0))):
        if bound is not None:
            out = out & F.coalesce(test, F.lit(False))
    return out


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` rows of highest cosine for each query vector, itself left out.

    ``queries``: (key, vector) of a stated query set. Queries are taken in blocks
    against all rows; every batch of rows hands on only its best ``k`` per query.
    Zero vectors, and rows of another length than the query, score 0; null vectors take no part.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v"))
    asked = [(r[0], r[1]) for r in queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).toLocalIterator()]
    out = None
    for s in range(0, max(len(asked), 1), BLOCK_QUERIES):
        part = _dense_block(spark, rows, asked[s : s + BLOCK_QUERIES], k, key)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _dense_block(spark: SparkSession, rows: DataFrame, asked: list, k: int, key: str) -> DataFrame:
    schema = f"query_id long, {key} long, score double"
    if not asked:
        return spark.createDataFrame([], schema)
    by_size: dict[int, tuple[list, list]] = {}
    for q, v in asked:
        ids, vs = by_size.setdefault(len(v), ([], []))
        ids.append(q)
        vs.append(v)
    shared = spark.sparkContext.broadcast({n: (np.array(i), _unit(np.array(v, float))) for n, (i, v) in by_size.items()})  # at most BLOCK_QUERIES vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, g in pdf.groupby(pdf.v.map(len)):
                ids = g[key].to_numpy()
                x = _unit(np.stack(g.v.to_numpy()).astype(float)) if n else np.zeros((len(g), 0))
                for m, (qid, q) in shared.value.items():
                    sim = np.round(q @ x.T, 9) if m == n else np.zeros((len(qid), len(ids)))
                    sim = np.where(qid[:, None] == ids[None], -2.0, sim)
                    order = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                    score = np.take_along_axis(sim, order, 1)
                    r, c = np.nonzero(score > -2)
                    yield pd.DataFrame({"query_id": qid[r], key: ids[order[r, c]], "score": score[r, c]})

    return rows.mapInPandas(run, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def rerank_window(rows: DataFrame, score: Column, n: int = 50, by: str = "query_id") -> DataFrame:
    """The first ``n`` ranks sorted anew by ``score``, ties and the tail in their order."""
    inside = F.col("rank") <= n
    order = [F.when(inside, 0).otherwise(1), F.when(inside, -score), F.col("rank")]
    return rows.withColumn("new_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def ir_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query of ``qrels``: p5, p10, r10, rr, ap, ndcg10, judged10, unjudged10.

    ``run``: (query_id, doc_id, rank), of a repeated document the first rank
    counts and ranks close up; ``qrels``: (query_id, doc_id, grade). Documents
    without a grade count as 0; a query without a relevant document scores 0.
    """
    first = run.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    judged = first.join(qrels, ["query_id", "doc_id"], "left")
    rel = (F.coalesce("grade", F.lit(0)) > 0).cast("int")
    seen = judged.withColumn("rel", rel).withColumn("hits", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank")))
    top = F.col("rank") <= 10
    gain = lambda g: (F.pow(F.lit(2.0), g) - 1)
    per = seen.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("rel5"),
        F.sum(F.when(top, F.col("rel")).otherwise(0)).alias("rel10"),
        F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))).alias("rr"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(top, gain(F.coalesce("grade", F.lit(0))) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(top & F.col("grade").isNotNull(), 1).otherwise(0)).alias("judged10"),
        F.sum(F.when(top & F.col("grade").isNull(), 1).otherwise(0)).alias("unjudged10"),
    )
    best = qrels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = best.groupBy("query_id").agg(F.sum((F.col("grade") > 0).cast("int")).alias("relevant"), F.sum(F.when(F.col("i") <= 10, gain(F.greatest("grade", F.lit(0))) / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(per, "query_id", "left").select(
        "query_id",
        zero(F.col("rel5") / 5.0).alias("p5"),
        zero(F.col("rel10") / 10.0).alias("p10"),
        zero(F.when(F.col("relevant") > 0, F.col("rel10") / F.col("relevant"))).alias("r10"),
        zero(F.col("rr")).alias("rr"),
        zero(F.when(F.col("relevant") > 0, F.col("precisions") / F.col("relevant"))).alias("ap"),
        zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg10"),
        F.coalesce("judged10", F.lit(0)).alias("judged10"),
        F.coalesce("unjudged10", F.lit(0)).alias("unjudged10"),
    )

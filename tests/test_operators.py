import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.functions import scores as S
from vellum.functions import text as T
from vellum.operators import gaps, graph, ingest, retrieval, sections, validation
from vellum.operators.components import connected_components


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_tokens_drop_stop_words_and_keep_hyphens(spark):
    assert one(spark, T.tokens(F.col("t")), t="The GPT-4 of COVID-19, the and é_x") == ["gpt-4", "covid-19", "é_x"]


@pytest.mark.parametrize("raw,want", [("3.1.2 data Collection", "Data Collection"), ("IV. RESULTS of the study", "Results of the Study"), ("A. Overview", "Overview"), ("Methods", "Methods")])
def test_heading(spark, raw, want):
    assert one(spark, T.heading(F.col("t")), t=raw) == want


@pytest.mark.parametrize("title,want", [("Limitations and Future Work", "LIMITATIONS"), ("Data", "DATA"), ("", "UNKNOWN"), ("Thanks", "OTHER"), ("Results and Discussion", "DISCUSSION"), ("Proposed Method", "METHODOLOGY")])
def test_section_type_takes_the_first_rule(spark, title, want):
    assert one(spark, T.section_type(F.col("t")), t=title) == want


def test_noise_boundaries(spark):
    text = lambda marks, words: " ".join(["et al."] * marks + ["word"] * (words - 2 * marks))
    assert one(spark, T.is_noise_text(F.col("t")), t=text(3, 50)) is True  # density of exactly 6
    assert one(spark, T.is_noise_text(F.col("t")), t=text(3, 51)) is False
    assert one(spark, T.is_noise_text(F.col("t")), t="  ") is True
    boiler = "copyright issn licence "
    assert one(spark, T.is_noise_text(F.col("t")), t=boiler + "w " * 33) is True  # 3 hits of 36 words
    assert one(spark, T.is_noise_text(F.col("t")), t=boiler + "w " * 34) is False


def test_doi_and_title_keys(spark):
    assert one(spark, T.doi_key(F.col("d")), d=" https://doi.org/10.1/AB ") == "10.1/ab"
    assert one(spark, T.doi_key(F.col("d")), d="doi: ") is None
    df = spark.createDataFrame([("A  Study: x", ["B. Lee", "A. Lee"], 2020), ("A", [], 0)], "t string, a array<string>, y int")
    assert [r[0] for r in df.select(T.title_key(F.col("t"), F.col("a"), F.col("y"))).collect()] == ["a study x|a_b_lee|2020", None]


@pytest.mark.parametrize("word,want", [("Neural-Networks", "neural network"), ("class", "class"), ("gas", "gas"), ("loss", "loss")])
def test_term_key(spark, word, want):
    assert one(spark, T.term_key(F.col("t")), t=word) == want


def test_inverted_index_keeps_the_last_word_of_a_position(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [1]},)], "i map<string,array<int>>")
    assert df.select(T.inverted_index_text(F.col("i"))).first()[0] == "a c b"


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None]


def test_upper_median_and_recency(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],)], "v array<double>")
    assert df.select(S.upper_median(F.col("v"))).first()[0] == 3.0
    r = spark.createDataFrame([(2020,), (2030,), (None,), (2000,)], "y int").select(S.recency(F.col("y"), F.lit(2024)).alias("r"))
    assert [x["r"] for x in r.collect()] == [0.6, 1.0, None, 0.0]


def test_ir_metrics_closed_form(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "b", 4)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 0), ("p", "z", 0)], "query_id string, doc_id string, grade int")
    m = {r["query_id"]: r for r in retrieval.ir_metrics(run, qrels).collect()}
    q = m["q"]
    assert (q["p5"], q["p10"], q["r10"], q["rr"], q["judged10"], q["unjudged10"]) == (0.4, 0.2, 1.0, 1.0, 2, 1)
    assert math.isclose(q["ap"], (1 + 2 / 3) / 2)
    assert math.isclose(q["ndcg10"], (3 + 1 / 2) / (3 + 1 / math.log2(3)))
    assert all(m["p"][c] == 0 for c in ("p5", "r10", "ap", "ndcg10"))


def test_rrf_and_cap(spark):
    a = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "d2", 1)], "query_id string, doc_id string, rank int")
    got = {r["doc_id"]: (r["score"], r["methods"]) for r in retrieval.rrf([("dense", a), ("sparse", b)]).collect()}
    assert math.isclose(got["d2"][0], 1 / 62 + 1 / 61) and got["d2"][1] == "dense+sparse"
    ranked = spark.createDataFrame([("q", i, p, 10.0 - i, i) for i, p in enumerate(["p", "p", "p", "r", None, None], 1)], "query_id string, doc_id int, paper_id string, score double, rank int")
    assert [r["doc_id"] for r in retrieval.cap_per_paper(ranked, 1, 4).orderBy("rank").collect()] == [1, 4, 5, 6]
    assert [r["doc_id"] for r in retrieval.cap_per_paper(ranked, 1, 5).orderBy("rank").collect()] == [1, 2, 4, 5, 6]  # filled up


def test_bm25_of_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "beta beta")], "doc_id int, text string")
    got = rows(retrieval.bm25(docs, {"q": "alpha"}).select("doc_id"))
    assert got == [(1,)]
    assert retrieval.bm25(docs.limit(0), {"q": "alpha"}).count() == 0


def test_dense_top_k_ties_and_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"]) for r in retrieval.dense_top_k(v, v.filter("vec_id = 1"), 3).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2), (4, 3)]


def greedy(items, penalty, most):
    left, counts, out = list(items), {}, []
    while left:
        key = lambda x: (round(x[0] - penalty * min(counts.get(x[1], 0), most), 6), x[0], x[2])
        best = max(left, key=key)
        left.remove(best)
        counts[best[1]] = counts.get(best[1], 0) + 1
        out.append(best[2])
    return out


def test_diversity_rank_is_the_greedy_order(spark):
    rng = random.Random(5)
    for _ in range(3):
        items = [(rng.randint(0, 20) / 20, rng.choice("xyz"), f"s{i:02d}") for i in range(30)]
        df = spark.createDataFrame(items, "score double, kind string, statement string")
        got = [r["statement"] for r in gaps.diversity_rank(df, "score", "kind", "statement").orderBy("rank").collect()]
        assert got == greedy(items, 0.05, 2)


def test_components_chain_hub_and_empty(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)] + [("solo", "solo"), (None, "x")]
    got = dict(rows(connected_components(spark.createDataFrame(links, "a string, b string"))))
    assert {got[f"c{i}"] for i in range(41)} == {"c0"} and {got[f"h{i}"] for i in range(50)} == {"h0"} and got["hub"] == "h0" and got["solo"] == "solo"
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_deduplicate_is_transitive_and_fills_fields(spark):
    papers = [("p1", "T one", "", "10.1/a", 2020, ["A"]), ("p2", "T two", "abs", "10.1/A", 2021, ["B"]), ("p3", "T two", "other", None, 2021, ["B"]), ("p4", "T", "x", None, 0, [])]
    df = spark.createDataFrame(papers, "paper_id string, title string, abstract string, doi string, year int, authors array<string>")
    d = ingest.deduplicate(df)
    assert dict(rows(d.select("paper_id", "canonical"))) == {"p1": "p1", "p2": "p1", "p3": "p1", "p4": "p4"}
    m = {r["canonical"]: r for r in ingest.merge_fields(d, ["title", "abstract", "year"]).collect()}
    assert (m["p1"]["title"], m["p1"]["abstract"], m["p1"]["year"], m["p4"]["year"]) == ("T one", "abs", 2020, None)


def test_parent_sections(spark):
    s = spark.createDataFrame([("p", "a", 1, 1), ("p", "b", 2, 2), ("p", "c", 3, 3), ("p", "d", 4, 2), ("p", "e", 5, 1)], "paper_id string, section_id string, section_order int, section_level int")
    assert dict(rows(sections.parent_sections(s).select("section_id", F.coalesce("parent", F.lit("-"))))) == {"a": "-", "b": "a", "c": "b", "d": "a", "e": "-"}


def test_chunker_limits_and_folding(spark):
    long = " ".join(f"Sentence number {i} is here to fill the text with words." for i in range(120))
    s = spark.createDataFrame([("p", 1, "Intro", "INTRODUCTION", long), ("p", 2, "Tiny", "OTHER", "few words"), ("p", 3, "Limits", "LIMITATIONS", "short but kept")], "paper_id string, section_order int, title string, section_type string, text string")
    c = sections.chunk_sections(s).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in c] == list(range(len(c)))
    assert max(len(r["text"]) for r in c) <= 3400 and c[-1]["section_type"] == "LIMITATIONS"
    assert any("Tiny\n\nfew words" in r["text"] or "Tiny few words" in r["text"] for r in c)


def test_tagger_longest_span_wins(spark):
    t = spark.createDataFrame([("c", "Deep learning and deep learning models; CT, ct scans. pre-deep learning"), ("d", None)], "chunk_id string, text string")
    got = rows(graph.tag_entities(t, {"deep learning": "M:dl", "deep learning models": "M:dlm", "=CT": "M:ct"}).drop("surfaces"))
    assert got == [("c", "M:ct", 1), ("c", "M:dl", 1), ("c", "M:dlm", 1)]


def test_communities_find_two_cliques(spark):
    names = ["a", "b", "c", "d"], ["w", "x", "y", "z"]
    e = [("r", p, q, 5, 2.0) for g in names for i, p in enumerate(g) for q in g[i + 1 :]] + [("r", "d", "w", 2, 0.1)]
    got = graph.communities(spark.createDataFrame(e, "run_id string, a string, b string, papers long, pmi double"))
    groups = {}
    for r in got.collect():
        groups.setdefault(r["community"], set()).add(r["entity"])
    assert sorted(map(sorted, groups.values())) == [list(names[0]), list(names[1])]


def test_gap_statement_cues(spark):
    df = spark.createDataFrame([(1, "LIMITATIONS", "This remains largely unexplored in all the clinics that we know of today. Nothing is said here about it at all by anyone."), (2, "RESULTS", "Too short, remains unclear.")], "doc_id int, section_type string, text string")
    assert [(r["doc_id"], r["cue"], r["strength"]) for r in gaps.gap_statements(df).collect()] == [(1, "OPEN_PROBLEM", 1.0)]


def test_confidence_caps_and_reasons(spark):
    base = dict(gap_score=0.9, supporting=3.0, counter=0.0, partial=0.0, contradictory=0.0, relevant=3, retrieval_coverage=0.25, adequacy=0.4, external_coverage=0.0, structural=False, against_items=0)
    cases = [base, base | {"relevant": 2}, base | {"retrieval_coverage": 0.2}, base | {"adequacy": 0.39}, base | {"external_coverage": 0.15, "structural": True}, base | {"counter": 6.0, "against_items": 2}]
    df = spark.createDataFrame([tuple(c.values()) for c in cases], list(base))
    got = [(r["confidence"], r["verdict"], r["reason"]) for r in validation.classify(validation.confidence(df)).collect()]
    assert got[0] == (1.0, "VALID_GAP", "SUPPORTED")
    assert got[1] == got[2] == (0.39, "UNSUPPORTED_GAP", "INSUFFICIENT_EVIDENCE")
    assert got[3] == (0.69, "UNCERTAIN_GAP", "WEAK_SUPPORT")
    assert got[4][2] == "CORPUS_ARTEFACT" and got[5][2] == "ADDRESSED_EXTERNALLY"


def test_prescore_statuses(spark):
    rows_ = [("a", "p1", "SUPPORTING", 1.0, 1.0, None), ("b", "p1", "COUNTER", 1.0, None, 1.0), ("c", "p1", "SUPPORTING", 0.2, 0.5, 0.1), ("c", "p2", "COUNTER", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows_, "gap_id string, paper_id string, stance string, relevance double, quality double, recency double")
    got = {r["gap_id"]: r["status"] for r in gaps.prescore(df).collect()}
    assert got == {"a": "SUPPORTED", "b": "INSUFFICIENT_EVIDENCE", "c": "CONTRADICTED"}


def test_results_do_not_depend_on_partitions(spark, sf):
    from vellum.plans import retrieval as R

    a = rows(R.bm25_topk(spark, sf))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(R.bm25_topk(spark, sf)) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

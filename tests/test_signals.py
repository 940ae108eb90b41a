import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.operators import evidence as E
from vellum.operators import gaps, graph, ingest, loop, neardup, retrieval, search, signals, worklists
from vellum.sources import providers


def column(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression).first()[0]


# ---- tagging, statements, claims


def test_tagger_forms_names_and_question_terms():
    words = graph.question_terms({"methods": ["Deep Nets", "ct", "x" * 70, None], "datasets": ["net"], "constraints": None}, {"net": "METHOD:net", "=CT": "MODALITY:ct"})
    assert words == {"net": "METHOD:net", "=CT": "MODALITY:ct", "Deep Nets": "METHOD:deep nets"}  # two letters are no term
    tag = graph.Tagger(words)
    assert [m[:2] for m in tag("A deep nets study, CT and ct, a net-like net on the Fooset-9 dataset; this dataset; Clinical dataset")] == [("METHOD:deep nets", "deep nets"), ("MODALITY:ct", "CT"), ("METHOD:net", "net"), ("DATASET:fooset-9", "Fooset-9")]
    assert tag("") == [] and graph.Tagger({}, False)("Any dataset") == []


def test_statements_are_rejected_weighted_and_unique(spark):
    gap = "However, the effect of these methods on small clinics remains largely unexplored in practice."
    data = [("c1", "p", "METHODS", "Open problems", gap), ("c2", "p", "OTHER", None, gap.upper().replace("HOWEVER", "However")), ("c3", "q", None, "Setup", gap), ("c4", "q", "RESULTS", None, "We propose a method whose robustness in the wild remains unexplored but is fine."), ("c5", "q", "RESULTS", None, None)]
    df = spark.createDataFrame(data, "chunk_id string, paper_id string, section_type string, title string, text string")
    got = {(r["paper_id"], r["chunk_id"], r["strength"]) for r in gaps.gap_statements(df, "chunk_id", "title", "paper_id").collect()}
    assert got == {("p", "c1", 0.9), ("q", "c3", 0.5)}


def test_claims_need_a_method_and_a_task(spark):
    t = "Our forest improves segmentation with accuracy of 91.5%. Our forest improves segmentation with Accuracy of 91.5%. The forest improves. Segmentation fails."
    df = spark.createDataFrame([("c", "Results", t), ("d", "METHODS", t)], "chunk_id string, section_type string, text string")
    got = E.result_claims(df, "chunk_id", {"forest": "METHOD:forest", "segmentation": "TASK:segmentation"}).collect()
    assert [(r["chunk_id"], r["direction"], r["metric"], r["value"], r["entities"]) for r in got] == [("c", "POSITIVE", "accuracy", "91.5%", ["METHOD:forest", "TASK:segmentation"])]


def test_curated_names_stay_apart(spark):
    data = [("M", "recall", 5, True, [1.0, 0.0]), ("M", "sensitivity", 4, True, [1.0, 0.01]), ("M", "recalls", 3, False, None), ("M", "hit rate", 2, False, [0.99, 0.02]), ("T", "recall", 1, None, [1.0, 0.0])]
    df = spark.createDataFrame(data, "type string, name string, papers int, curated boolean, embedding array<double>")
    assert rows(graph.canonical_forms(df)) == [("M", "hit rate", "recall"), ("M", "recall", "recall"), ("M", "recalls", "recall"), ("M", "sensitivity", "sensitivity"), ("T", "recall", "recall")]


# ---- flags, cores, scores


def test_flags_and_cores(spark):
    e = spark.createDataFrame([("r", "TASK:deep learning", ["DL"], False, 4), ("r", "TASK:ocr", ["text reading"], False, 3), ("r", "TASK:all", None, True, 9), ("r", "TASK:zz", [], False, 2)], "run_id string, entity string, aliases array<string>, generic boolean, papers int")
    f = signals.flagged_entities(e, spark.createDataFrame([("r", "Text-reading with Deep learnings")], "run_id string, question string"))
    assert {r["entity"]: (r["query_term"], r["specific"]) for r in f.collect()} == {"TASK:deep learning": (True, False), "TASK:ocr": (True, False), "TASK:all": (False, False), "TASK:zz": (False, True)}
    own = e.withColumn("specific", F.lit(True))
    m = spark.createDataFrame([("r", 1, "a", ["TASK:zz", "TASK:ocr"]), ("r", 1, "b", ["TASK:ocr"]), ("r", 1, "c", ["TASK:all"]), ("r", 2, "d", ["TASK:zz"])], "run_id string, cluster int, statement_id string, entities array<string>")
    assert rows(signals.core_entities(m, own).select("cluster", F.array_join("core", "|"))) == [(1, "TASK:ocr"), (2, "TASK:zz")]


@pytest.mark.parametrize("cited,want", [("c-1", "c-1"), ("[chunk_id: c-1]", "c-1"), ("`(id = c-1)`", "c-1"), ("see c-1", "see c-1"), ('"[[Chunk ID: c-1]]"', "c-1")])
def test_citations(spark, cited, want):
    assert column(spark, signals.resolved_citation(F.col("c")), c=cited) == want


def test_statements_lose_connectives_in_order(spark):
    assert column(spark, signals.clean_statement(F.col("s")), s=" However, moreover, it fails.") == "It fails."
    assert column(spark, signals.clean_statement(F.col("s")), s="Overall, however, it fails.") == "However, it fails."
    assert column(spark, signals.clean_statement(F.col("s")), s="However, Furthermore, it fails.") == "It fails."
    assert column(spark, signals.clean_statement(F.col("s")), s="However,") == "However,"


def test_full_score_by_hand(spark):
    data = [("a", 2.0, 3, 0.8, 0.9, False, 2, None, ["d1"], 25), ("b", 0.0, 0, 0.5, None, True, 9, 0.4, ["d1", "d2"], 100)]
    df = spark.createDataFrame(data, "gap_id string, support double, stating_papers int, sparsity_raw double, staleness double, external boolean, span int, novelty double, detectors array<string>, on_topic_papers int")
    got = {r["gap_id"]: (r["gap_score"], r["baseline_score"]) for r in signals.full_score(df).collect()}
    e = 1 - 2.718281828459045**-1
    assert got["a"] == (round((0.25 * e + 0.25 * 0.4 + 0.075 * 0.9 + 0.15) / 0.725, 4), round(0.45 * 0.8 + 0.35 * 0.9, 4))
    assert got["b"] == (round((0.25 * 0.5 + 0.10 * 0.4) / 0.75 + 0.1 / 3, 4), round(0.45 * 0.5 + 0.2 * 0.4, 4))


def test_candidates_take_turns(spark):
    c = spark.createDataFrame([("r", f"s{k}", "signal", k) for k in range(9)] + [("r", "l1", "llm", 1), ("r", "l2", "llm", 2)], "run_id string, gap_id string, source string, rank int")
    assert [r["gap_id"] for r in signals.interleaved(c, 6).orderBy("place").collect()] == ["s0", "l1", "s1", "l2", "s2", "s3"]
    with pytest.raises(LookupError, match="nope"):
        loop.batch(c, ["s1", "nope"])
    assert rows(loop.batch(c, ["s1"]).select("gap_id")) == [("s1",)]


# ---- near-duplicates


def test_near_duplicates_are_dropped_as_in_a_pass(spark):
    rng = random.Random(8)
    data = [(f"i{k:03d}", " ".join(rng.sample(["ab", "cd", "ef", "gh", "ij", "kl", "mn"], rng.randint(1, 6))), float(rng.randint(0, 5))) for k in range(80)] + [("x", None, 9.0), ("y", "!!!", 1.0), ("z", "???", 0.5), ("u", "Straße", 3.0), ("v", "STRASSE.", 2.0)]
    kept, want = [], {}
    for i, s, _ in sorted(data, key=lambda r: (-r[2], (r[1] or "").lower(), r[0])):
        t = set("".join(ch if ch.isalnum() else " " for ch in (s or "").casefold()).split())
        key = "".join(ch for ch in (s or "").casefold() if ch.isalnum())
        hit = next((k for k, (u, other) in kept if (key and key == other) or (t and u and len(t & u) / len(t | u) >= 0.8)), None)
        if hit is None:
            kept.append((i, (t, key)))
            want[i] = 0
        else:
            want[hit] += 1
    df = spark.createDataFrame(data, "id string, s string, score double")
    assert dict(rows(neardup.without_duplicates(df, "id", "s", "score").select("id", "merged"))) == want
    assert neardup.without_duplicates(df.limit(0), "id", "s", "score").count() == 0


def test_normal_forms(spark):
    df = spark.createDataFrame([("ﬁne Ｘ",), ("é",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(neardup.folded(F.col("t"))).collect()] == ["fine x", "é", "abc", None]
    assert [r[0] for r in df.select(neardup.composed(F.col("t"))).collect()] == ["ﬁne Ｘ", "é", "ABC", None]


# ---- search


def test_arguments_are_checked():
    assert search.checked({"a": " x ", "b": "x", "c": " "}) == {"a": "x"}
    for bad in ({"queries": {"a": " "}}, {"queries": {"a": "x"}, "method": "magic"}, {"queries": {"a": "x"}, "top_k": 0}, {"queries": {"a": "x"}, "top_k": 101}, {"queries": {"a": "x"}, "top_k": True}):
        with pytest.raises(ValueError):
            search.checked(**bad)


def test_dense_uses_stored_vectors_first(spark):
    d = spark.createDataFrame([(1, "cat cat", None), (2, "dog", [1.0, 0.0, 0.05]), (3, " ", None), (4, None, None), (5, "cat dog", None)], "doc_id long, text string, v array<double>")
    embed = search.term_embedder(["cat", "dog"])
    assert [r[1] for r in sorted(rows(search.dense(d, {"q": "cat"}, embed, 9).select("rank", "doc_id")))] == [1, 5, 2]
    assert [r[1] for r in sorted(rows(search.dense(d, {"q": "cat"}, embed, 9, stored="v").select("rank", "doc_id")))] == [2, 1, 5]


def test_hybrid_keeps_contributors_and_ties_by_document(spark):
    rank = lambda *ids: spark.createDataFrame([("q", i, 1.0 / k, k) for k, i in enumerate(ids, 1)], "query_id string, doc_id string, score double, rank int")
    got = search.fuse([("dense", rank("b", "a")), ("sparse", rank("a", "b", "c")), ("third", rank())]).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == got[1]["score"]
    assert [(c["method"], c["rank"]) for c in got[0]["contributors"]] == [("dense", 2), ("sparse", 1)]


def test_rerank_window_failures_and_cap(spark):
    data = [("q", f"d{k}", f"p{k // 3}", 1.0 - k / 10, k + 1, float(k)) for k in range(6)]
    df = spark.createDataFrame(data, "query_id string, doc_id string, paper_id string, score double, rank int, s double")
    got = search.rerank(df, F.col("s"), 3)
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == ["d2", "d1", "d0", "d3", "d4", "d5"]
    kept = retrieval.cap_per_paper(got, 1, 3, reranked=True).orderBy("rank").collect()
    assert [r["doc_id"] for r in kept] == ["d2", "d1", "d3"]  # filled up, in the order of the reranking
    with pytest.raises(Exception, match="finite"):
        search.rerank(df, F.lit(float("nan")), 3).collect()
    opened = search.rerank(df, F.when(F.col("doc_id") == "d1", F.lit(None)).otherwise(F.col("s")), 3, fail_open=True)
    assert [r["doc_id"] for r in opened.orderBy("rank").collect()] == [f"d{k}" for k in range(6)]


def test_kept_index_equals_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, ""), (5, "delta alpha alpha")], "doc_id long, text string")
    q = {"q": "alpha beta alpha", "none": "zeta"}
    index = search.build_index(docs, folder=str(tmp_path / "index"))
    again = search.open_index(spark, str(tmp_path / "index"))
    want = rows(retrieval.ranked(retrieval.bm25(docs, q).withColumn("score", F.round("score", 6))))
    assert rows(search.search_index(index, q)) == rows(search.search_index(again, q)) == want
    assert not search.is_stale(again, docs) and search.is_stale(again, docs.filter("doc_id <> 4")) and search.is_stale(again, docs.unionByName(docs.limit(1)))


def test_cache_lives_for_a_while(spark):
    now, built = [0.0], []
    cache = search.CorpusCache(10, lambda: now[0])
    build = lambda: built.append(1) or spark.range(3)
    assert cache.get("r", build).count() == 3 and cache.get("r", build).count() == 3 and len(built) == 1
    now[0] = 11.0
    assert cache.get("r", build).count() == 3 and len(built) == 2
    cache.clear()
    assert cache.get("r", build).count() == 3 and len(built) == 3


# ---- stages and sources


def test_stages(spark):
    cols = "paper_id string, full_text_status string, parsing_status string, section_status string, chunk_status string, embedding_status string"
    p = spark.createDataFrame([("a", None, None, None, None, None), ("b", "DOWNLOADED", None, None, None, None), ("c", "DOWNLOADED", "PARSED", None, None, None), ("d", "DOWNLOADED", "PARSED", "EXTRACTED", "CHUNKED", "EMBEDDED"), ("e", "DOWNLOADED", "PARSE_FAILED", None, None, None)], cols)
    s = spark.createDataFrame([("r", x) for x in "abcde"] + [("r", "a"), ("o", "d")], "run_id string, paper_id string")
    due = lambda stage: [r[0] for r in rows(worklists.worklist(p, s, stage).filter("run_id = 'r'").select("paper_id"))]
    assert [due(x) for x in ("acquisition", "parsing", "sectioning", "chunking", "representation", "corpus")] == [["a"], ["b", "e"], ["c"], [], ["d"], ["d"]]
    back = {r["paper_id"]: (r["section_status"], r["chunk_status"], r["embedding_status"]) for r in worklists.reset(p, s, "o", "chunking").collect()}
    assert back["d"] == ("EXTRACTED", "NOT_CHUNKED", "NOT_EMBEDDED") and back["c"] == (None, None, None)
    done = spark.createDataFrame([("c", True), ("c", False), ("b", False), ("d", False), ("e", None)], "paper_id string, ok boolean")
    after = {r["paper_id"]: r["parsing_status"] for r in worklists.finish(p, done, "parsing").collect()}
    assert after == {"a": None, "b": "PARSE_FAILED", "c": "PARSED", "d": "PARSED", "e": "PARSE_FAILED"}
    with pytest.raises(ValueError):
        worklists.reset(p, s, "r", "acquisition")


def test_broken_answers_are_skipped(spark):
    a = spark.createDataFrame([('{"id": "https://openalex.org/W1", "title": " ", "authorships": [{"author": {"display_name": " A "}}, {"author": null}], "abstract_inverted_index": {"b": [1], "a": [0, 1]}, "doi": "https://doi.org/10.1/x"}',), ("not json",), (None,), ("[]",)], "body string")
    got = providers.openalex_papers(a).collect()
    assert [(r["provider_id"], r["title"], r["authors"], r["abstract"], r["doi"], r["paper_url"]) for r in got] == [("W1", "(No title)", ["A"], "a b", "10.1/x", "https://openalex.org/W1")]
    s = spark.createDataFrame([('{"paperId": "p", "title": "T", "externalIds": {"DOI": "10.1/y"}, "openAccessPdf": {"url": "u", "status": "GOLD"}}',), ("{",)], "body string")
    assert [(r["provider_id"], r["doi"], r["full_text_url"]) for r in providers.semantic_scholar_papers(s).collect()] == [("p", "10.1/y", "u")]


def test_graphml_is_well_formed(spark):
    from xml.etree import ElementTree

    n = spark.createDataFrame([("a", "Entity", 'x < "y" & z'), ("a", "Entity", "again"), ("b", "Paper", None)], "id string, kind string, label string")
    e = spark.createDataFrame([("a", "b", "ON", 1.5)], "src string, dst string, kind string, weight double")
    text = "".join(r["line"] for r in providers.graphml(n, e).orderBy("part", "line").collect())
    graph_ = ElementTree.fromstring(text)[-1]
    assert [x.tag.split("}")[1] for x in graph_] == ["node", "node", "edge"]


def test_provider_ids_tie_papers_and_collections_fail_in_part(spark):
    p = spark.createDataFrame([("p1", "A", 2020, None), ("p2", "B", 2021, None), ("p3", "C", 2021, None)], "paper_id string, title string, year int, doi string").withColumn("authors", F.array().cast("array<string>"))
    s = spark.createDataFrame([("p1", "x", "7"), ("p3", "x", "7"), ("p2", "y", "7"), ("p2", "x", None)], "paper_id string, provider string, provider_id string")
    d = ingest.deduplicate(p, sources=s)
    assert dict(rows(d.select("paper_id", "canonical"))) == {"p1": "p1", "p2": "p2", "p3": "p1"}
    assert ingest.moved_sources(s, d).count() == 3 and rows(ingest.dedup_stats(d)) == [(3, 1, 1)]
    data = [(q, f"query {q}", src, f"{src}{q}{k}", k) for q in range(6) for src in "ab" for k in range(3)] + [(9, "QUERY  0", "a", "a00", 9)]
    t = spark.createDataFrame(data, "query_place int, source_query string, source string, item_id string, result_rank int")
    fail = spark.createDataFrame([("b", "query 1", "RATE_LIMITED"), ("a", "query 2", "TIMEOUT")], "source string, source_query string, kind string")
    got = ingest.collected(t, fail, 2, 5).collect()
    assert sorted(r["item_id"] for r in got) == ["a00", "a01", "a10", "a11", "a30", "b00", "b01"] and {(r["source"], r["capped"], r["status"]) for r in got} == {("a", True, "partial"), ("b", True, "partial")}


# ---- the loop


def test_search_goes_on_until_enough_is_found(spark):
    g = spark.createDataFrame([("g1", "few things about soil", ["TASK:soil mapping", "METHOD:forest"], "field"), ("g2", "s", ["TASK:x"], None)], "gap_id string, statement string, core array<string>, anchor string")
    aliases = spark.createDataFrame([("METHOD:forest", f"alias {c}") for c in "abcdefg"], "entity string, alias string")
    siblings = spark.createDataFrame([("g1", "METHOD:forest", "METHOD:tree", 3), ("g1", "TASK:soil mapping", "TASK:other", 9)], "gap_id string, entity string, sibling string, shared long")
    first = loop.first_queries(g, aliases, siblings)
    got = {(r["search"], r["place"]): r["query"] for r in first.filter("gap_id = 'g1'").collect()}
    assert got["direct", 0] == "soil mapping forest field" and got["terminology", 0] == "soil mapping alias a field" and got["method_variation", 0] == "soil mapping tree field" and got["counter", 1] == "soil mapping forest field proposed method improves"
    assert ("terminology", 2) not in got and ("method_variation", 1) not in got
    find = lambda q: q.filter("gap_id = 'g2'").select("gap_id", "query", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("id"))
    assess = lambda q, h: q.select("gap_id").distinct().join(h.groupBy("gap_id").agg(F.count("*").alias("n")), "gap_id", "left").select("gap_id", F.coalesce("n", F.lit(0)).alias("relevant"), F.lit(1.0).alias("retrieval"), F.lit(None).cast("double").alias("concept"))
    asked, hits, rounds = loop.iterate(g, first, lambda on, used: loop.refined_queries(on, aliases, used), find, assess)
    assert rounds == 3 and hits.select("gap_id").distinct().count() == 1
    more = asked.join(first.select("gap_id", "query"), ["gap_id", "query"], "left_anti")
    assert {r["gap_id"] for r in more.collect()} == {"g1"} and {"soil mapping forest", "alias c field"} <= {r["query"] for r in more.collect()}
    with pytest.raises(ValueError, match="offline"):
        loop.search_sources(first, {"offline": lambda q: None})


def test_failures_of_a_model_are_values(spark):
    df = spark.createDataFrame([("{\"a\": 1}",), ("[1]",), ("key_abcdefgh12 text",), ("none",)], "p string")
    got = loop.attempt(df, lambda p: F.when(p != "none", p), "p", "a int").orderBy("p").collect()
    by = {r["p"]: r["answer"] for r in got}
    assert by['{"a": 1}']["ok"] and by['{"a": 1}']["value"]["a"] == 1 and not by["[1]"]["ok"] and by["none"]["error"] == "PROVIDER_FAILED"
    assert "[redacted]" in by["key_abcdefgh12 text"]["error"] and "abcdefgh12" not in by["key_abcdefgh12 text"]["error"]


def test_topics_of_vectors(spark):
    t = spark.createDataFrame([("r", "a", "c1"), ("r", "a", "c2"), ("r", "b", "c3"), ("r", "b", "c4")], "run_id string, topic string, chunk_id string")
    c = spark.createDataFrame([("r", f"c{k}", f"p{k}") for k in (1, 2, 3, 4)], "run_id string, chunk_id string, paper_id string")
    p = spark.createDataFrame([("r", "p1", 2020), ("r", "p2", 2015), ("r", "p3", None), ("r", "p4", 2019)], "run_id string, paper_id string, year int")
    v = spark.createDataFrame([("c1", [2.0, 0.0]), ("c2", [1.0, 0.0]), ("c3", [0.0, 3.0]), ("c4", [0.0, 0.0])], "chunk_id string, embedding array<double>")
    got = {r["topic"]: (r["density"], r["recent_share"], r["max_similarity"], r["novelty"]) for r in signals.topic_profile(t, c, p, v).collect()}
    assert got == {"a": (1.0, 0.5, 0.0, 0.75), "b": (1.0, 0.5, 0.0, 0.75)}


def test_items_are_counted_without_being_paired_with_gaps(spark):
    many, gaps_n = 300, 200
    gaps = spark.createDataFrame([(f"g{i}", "r", ["m"], "can") for i in range(gaps_n)] + [("g0", "s", ["m"], "the"), ("h", "r", ["m"], "none")], "gap_id string, run_id string, core array<string>, word string")
    items = spark.createDataFrame([("can", f"i{k}") for k in range(many)] + [("the", "i0"), ("the", "x")], "word string, id string")
    counted = loop.items_by_words(gaps, items)
    got = dict(counted.collect())
    assert got == {"g0": many + 1} | {f"g{i}": many for i in range(1, gaps_n)}  # i0 counts once for a gap of both words
    # No join may hold a row for each gap and item.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = loop.items_by_words(gaps, items)
        again.collect()
        most, todo = 0, [again._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(k) for k in range(children.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < most <= 3 * (many + gaps_n)

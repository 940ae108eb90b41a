import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vellum.operators import evidence as E


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("This remains unclear.", "LENGTH"),
        ("Our tool remains limited to a small number of cases in this hospital today.", "SELF_REFERENCE"),
        ("To overcome the limitation of earlier work we need many more labelled images here.", "CONTRIBUTION"),
        ("Traditional examination relies on experts who are still lacking in many rural places.", "MOTIVATION"),
        ("Volume 12 of this series says that the question remains largely unexplored until now.", "PAGE_HEADER"),
        ("As shown in [12] and also in [13] the question remains largely unexplored so far.", "CITATIONS"),
        ("Gap category and what remains unexplored are listed for every paper of the field.", "TABLE_HEADER"),
        ("Deep Learning For Medical Image Analysis Remains Largely Unexplored In Many Places", "CAPITALS"),
        ("1 Assisted diagnosis remains unexplored; accuracy 96.4 % and later accuracy 94 % were seen.", "TABLE"),
        ("It remains largely unexplored how such models behave on data from other hospitals.", None),
    ],
)
def test_rejections(spark, sentence, want):
    assert spark.createDataFrame([(sentence,)], "s string").select(E.rejection(F.col("s"))).first()[0] == want


def test_claims(spark):
    df = spark.createDataFrame([("c", "RESULTS", "Our net outperforms it with accuracy of 96.4%. It fails and improves. Nothing here. It fails and improves."), ("d", "METHODS", "It outperforms all."), ("e", "ABSTRACT", None)], "chunk_id string, section_type string, text string")
    got = sorted((r["chunk_id"], r["direction"], r["metric"], r["value"]) for r in E.result_claims(df).collect())
    assert got == sorted([("c", "MIXED", None, None), ("c", "POSITIVE", "accuracy", "96.4%")], key=str) or set(got) == {("c", "MIXED", None, None), ("c", "POSITIVE", "accuracy", "96.4%")}


def test_addressed_later(spark):
    gaps = spark.createDataFrame([("g", ["a", "b"], 2018), ("h", ["a"], 2018), ("i", ["a", "b"], None)], "gap_id string, concepts array<string>, latest int")
    chunks = [("c1", "p1", 2019, "RESULTS", e) for e in "ab"] + [("c2", "p1", 2019, "RESULTS", e) for e in "ab"] + [("c3", "p2", 2018, "RESULTS", e) for e in "ab"] + [("c4", "p3", 2020, "RESULTS", "a")] + [("c5", "p4", 2020, "INTRODUCTION", e) for e in "ab"] + [("c6", "p5", 2021, "METHODS", e) for e in "ab"]
    ce = spark.createDataFrame(chunks, "chunk_id string, paper_id string, year int, section_type string, entity string")
    stating = spark.createDataFrame([("g", "p5")], "gap_id string, paper_id string")
    assert rows(E.addressed_later(gaps, ce, stating)) == [("g", "c1", "p1", 2019)]


def test_hosts_grounding_and_merge(spark):
    guests = spark.createDataFrame([("r", "g1", ["a", "b"]), ("r", "g2", ["a", "c"]), ("r", "g3", ["z"])], "grp string, guest string, concepts array<string>")
    hosts = spark.createDataFrame([("r", "h1", 1, ["a", "b", "c"]), ("r", "h0", 0, ["b", "d"])], "grp string, host string, place int, core array<string>")
    assert rows(E.host_of(guests, hosts)) == [("r", "g1", "h1"), ("r", "g2", "h1")]
    s = spark.createDataFrame([("g", [1.0, 0.0]), ("h", [0.0, 1.0])], "gap_id string, embedding array<double>")
    e = spark.createDataFrame([("g", [0.6, 0.8]), ("g", [0.0, 1.0])], "gap_id string, embedding array<double>")
    assert rows(E.grounded(s, e)) == [("g", 0.6, True), ("h", 0.0, False)]
    signal = spark.createDataFrame([("models lack robust data", 1), ("other thing", 2)], "statement string, place int")
    llm = spark.createDataFrame([("Models lack robust data!", 1), ("brand new idea", 2)], "statement string, place int")
    assert rows(E.merge_candidates(signal, llm)) == [("brand new idea", "llm"), ("models lack robust data", "signal+llm"), ("other thing", "signal")]


def test_external_coverage_and_iteration(spark):
    d = spark.createDataFrame([("Alpha and beta",), ("alpha",), ("ALPHA",), (None,), ("beta",)], "text string")
    assert rows(E.external_coverage(d, {"g": ["alpha", "beta"], "one": ["alpha"]})) == [("g", 1, 2, 0.5)]
    assert rows(E.external_coverage(d.limit(0), {"g": ["alpha", "beta"]})) == [("g", 0, 0, 0.0)]
    assert E.iterate_again(1, 4, 1.0, 1.0) and not E.iterate_again(3, 0, 0.0, 0.0) and not E.iterate_again(1, 5, 0.5, 1.0) and E.iterate_again(1, 5, 0.5, 0.9)

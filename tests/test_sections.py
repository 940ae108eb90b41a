import pytest

from tests.conftest import rows
from vellum.functions import text as T
from vellum.operators import sections as S

BODY = "This paragraph holds quite a few words so that it reads like prose and no heading."


def page(spark, *texts, paper="p"):
    return spark.createDataFrame([(paper, n, t) for n, t in enumerate(texts, 1)], "paper_id string, page_number int, text string")


@pytest.mark.parametrize(
    "line,level,numbering",
    [("1 Introduction", 1, "1"), ("2.3 Data Collection", 2, "2.3"), ("IV. RESULTS", 1, "IV"), ("A. Limitations", 1, "A"), ("Future Work", 1, ""), ("Results on Noisy Images", 1, "")],
)
def test_headings(spark, line, level, numbering):
    got = rows(S.heading_candidates(page(spark, f"{BODY}\n\n{line}\n\n{BODY}\n{BODY}")).select("i", "line", "level", "numbering"))
    assert got == [(2, line, level, numbering)]


@pytest.mark.parametrize(
    "line",
    ["12", "Figure 3: Results", "Table 2", "[4] Smith et al. 2019", "Page 4", "3 of 12", "see results in the", "Smith, J., Doe, A. Results", "Conclusion of x = y + z^2 * q", "this starts small", "Journal Volume 8, Issue 2", "x" * 130, "We measured very many things and found that all of them hold."],
)
def test_no_headings(spark, line):
    assert rows(S.heading_candidates(page(spark, f"{BODY}\n\n{line}\n\n{BODY}"))) == []


def test_blank_lines_everywhere_tell_nothing(spark):
    text = "\n\n".join(["Some Odd Words"] * 6)
    assert rows(S.heading_candidates(page(spark, text))) == []
    assert rows(S.heading_candidates(page(spark, None, ""))) == []


def test_sections_pages_and_fallback(spark):
    p = page(spark, f"Front matter\n1 Introduction\n{BODY}\n\n\n\n{BODY}", f"{BODY}\n\n2 Limitations\n\n{BODY}").unionByName(page(spark, BODY.lower(), paper="q")).unionByName(page(spark, None, paper="r"))
    got = {(r["paper_id"], r["section_order"]): r for r in S.extract_sections(p).collect()}
    assert set(got) == {("p", 0), ("p", 1), ("q", 0), ("r", 0)}
    a, b = got["p", 0], got["p", 1]
    assert (a["title"], a["normalized_title"], a["section_type"], a["page_start"], a["page_end"]) == ("1 Introduction", "Introduction", "INTRODUCTION", 1, 2)
    assert a["text"] == f"{BODY}\n\n{BODY}\n{BODY}" and b["text"] == BODY and b["section_type"] == "LIMITATIONS" and b["page_start"] == 2
    assert got["q", 0]["title"] == "Document Body" and got["q", 0]["section_type"] == "UNKNOWN" and got["r", 0]["text"] == ""
    assert S.extract_sections(p.limit(0)).count() == 0


def test_parents_of_deep_levels(spark):
    levels = [1, 2, 3, 4, 5, 6, 7, 6, 2]
    s = spark.createDataFrame([("p", f"s{k}", k, n) for k, n in enumerate(levels)], "paper_id string, section_id string, section_order int, section_level int")
    got = {r["section_id"]: r["parent"] for r in S.parent_sections(s).collect()}
    assert got == {"s0": None, "s1": "s0", "s2": "s1", "s3": "s2", "s4": "s3", "s5": "s4", "s6": "s5", "s7": "s4", "s8": "s0"}


def test_unwrapped_lines(spark):
    raw = "A line\nthat is wrap-\nped, and Big-\nName.\n  \t\nNext  one.\n\n\nLast"
    got = spark.createDataFrame([(raw,)], "t string").select(T.unwrapped("t")).first()[0]
    assert got == "A line that is wrapped, and Big- Name.\n\nNext one.\n\nLast"


def chunk(spark, sections, **sizes):
    df = spark.createDataFrame([("p", k, *s) for k, s in enumerate(sections)], "paper_id string, section_order int, title string, section_type string, text string")
    return S.chunk_sections(df, **sizes).orderBy("chunk_index").collect()


def test_chunks_gather_paragraphs_with_overlap(spark):
    paragraphs = ["One is here. Two is here.", "Three is here. Four is here.", "Five is here."]
    got = chunk(spark, [("T", "RESULTS", "\n\n".join(paragraphs))], target=45, limit=60, overlap=20, least_words=0)
    # The overlap is the whole sentences of the last 20 characters, and isn't counted in the target.
    assert [r["text"] for r in got] == [paragraphs[0], f"Two is here.\n\n{paragraphs[1]}\n\n{paragraphs[2]}"]
    assert [(r["char_start"], r["char_end"]) for r in got] == [(2, 27), (29, 72)]


def test_chunks_of_long_paragraphs_and_sentences(spark):
    long = "a" * 50 + ". " + "B" * 130 + ". Cc dd."
    got = chunk(spark, [("T", "RESULTS", long)], target=60, limit=80, overlap=10, least_words=0)
    assert [r["text"] for r in got] == ["a" * 50 + ".", "aaaaaaaaa. " + "B" * 60, "B" * 10 + " " + "B" * 60, "B" * 10 + " " + "B" * 10 + ".", "B" * 9 + ".\n\nCc dd."]
    assert got[0]["token_count"] == 12 and len({r["chunk_id"] for r in got}) == 5


def test_small_sections_and_chunks_fold(spark):
    words = lambda n, w: " ".join([w] * n)
    got = chunk(spark, [("Early", "OTHER", "few words"), ("Intro", "INTRODUCTION", words(70, "in")), ("Limits", "LIMITATIONS", "short but kept"), ("Name", "OTHER", "between"), ("End", "CONCLUSION", words(65, "end")), ("Late", "OTHER", "")])
    assert [r["section_type"] for r in got] == ["INTRODUCTION", "LIMITATIONS", "CONCLUSION"]
    assert got[0]["text"].startswith("Early\n\nfew words\n\nin in") and got[1]["text"] == "short but kept"
    assert got[2]["text"].startswith("Name\n\nbetween\n\nend") and got[2]["text"].endswith("end\n\nLate")
    only = chunk(spark, [("A", "OTHER", "tiny"), ("B", "OTHER", "also")])
    assert [r["text"] for r in only] == ["tiny\n\nB\n\nalso"]
    assert chunk(spark, [("A", "OTHER", None), ("B", None, " \n ")], least_words=0) == []

"""Queries on rows of any script, length and number."""

import hashlib
import random
from datetime import datetime
from itertools import combinations

import pytest

from tests.conftest import rows
from vellum.plans import registry

T0 = datetime(2024, 1, 1)
ITEM = "source string, source_query string, item_id string, result_rank int, title string, abstract string, year int, doi string, fetched_at timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def items(tables, *data):
    return tables("external_items", [("s", "q", i, 1, title, "", year, doi, T0) for i, title, year, doi in data], ITEM)


def test_titles_of_any_script_and_dois_of_any_form(spark, tables):
    d = items(tables, ("a", "Étude de la forêt", 2020, None), ("b", "étude de la  FORÊT", 2020, None), ("c", None, 2020, "odd/1"), ("d", "Other", 2021, "odd/1"))
    q = registry.QUERIES
    assert rows(q["exact_dedup_components"](spark, d)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")]
    assert {r["canonical"]: (r["title"], r["members"]) for r in q["dedup_merged_fields"](spark, d).collect()} == {"a": ("Étude de la forêt", 2), "c": (None, 2)}  # titles are never inherited
    assert {r["item_id"] for r in q["title_author_year_key"](spark, d).collect()} == {"a", "b", "d"}
    assert {(r["key"], r["rows"]) for r in q["distinct_case_insensitive"](spark, d).collect()} == {("étude de la forêt", 2), ("other", 1)}


def test_texts_of_any_length_and_script(spark, tables):
    long, lines = "wörd other " * 400, "first line\nsecond – line"
    d = tables("documents", [(1, long), (2, "short one"), (3, None), (4, "")], "doc_id long, text string")
    tables("sections", [("x", lines, 1, 2), ("y", None, 1, 1)], "section_id string, text string, page_start int, page_end int")
    md5 = lambda t: hashlib.md5(t.strip().encode()).hexdigest()
    assert rows(registry.QUERIES["abstract_from_inverted_index"](spark, d)) == [(1, md5(long)), (2, md5("short one"))]
    assert rows(registry.QUERIES["page_snippets"](spark, d)) == [("x", "first line second – line", "1-2")]


MENTION = "run_id string, chunk_id string, paper_id string, entity_id string, mention_count int, tagged_at timestamp"


def mentions(tables, *data):
    return tables("kg_mentions", [("r", f"c{p}", f"p{p}", e, 1, T0) for p, e in data], MENTION)


def test_the_typed_graph_has_communities(spark, tables):
    d = mentions(tables, *[(p, f"TASK:{e}") for p in range(6) for e in (("x", "y", "z") if p < 3 else ("u", "v"))])
    tables("kg_papers", [("r", f"p{p}", T0) for p in range(6)], "run_id string, paper_id string, built_at timestamp")
    got = {r["kind"]: (r["edges"], r["weight"]) for r in registry.QUERIES["graph_edge_kinds"](spark, d).collect()}
    assert got == {"MENTIONS": (15, 15), "CO_OCCURS": (4, 12), "IN_COMMUNITY": (5, 5), "STATES": (6, 6), "ABOUT": (15, 15)}


def test_names_of_near_vectors_are_one_entity(spark, tables):
    name = "graph based learning of sparse visual representations in large networks"
    d = mentions(tables, (1, f"TASK:{name}"), (2, f"TASK:{name} too"), (3, "TASK:soil"))
    tables("kg_entities", [("TASK:soil", "TASK", "soil")], "entity_id string, entity_type string, name string")
    assert rows(registry.QUERIES["canonical_entities"](spark, d)) == [("TASK", 3, 2)]


def test_near_duplicate_statements_need_no_doi(spark, tables):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    d = items(tables, ("a", ten, 2020, None), ("b", ten.upper(), 2021, "10.1/abcdef"), ("c", ten.replace("alpha", "omega"), 2020, None), ("d", "alpha beta", 2020, None), *[(f"f{k:02d}", "Same words", 2020, "10.1/sharedxx") for k in range(60)])
    got = rows(registry.QUERIES["statement_jaccard_neardup"](spark, d))
    assert got == sorted([("a", "a", 1.0), ("a", "b", 1.0), ("c", "c", 1.0), ("d", "d", 1.0), ("a", "c", round(9 / 11, 6)), *[("f00", f"f{k:02d}", 1.0) for k in range(60)]])


def test_near_duplicates_equal_brute_force(spark, tables):
    rng = random.Random(2)
    titles = [rng.sample("abcdefghijkl", rng.randint(1, 11)) for _ in range(120)]
    d = items(tables, *[(f"i{k:03d}", " ".join(f"word{w}" for w in t), 2020, None) for k, t in enumerate(titles)])
    first = {}
    for k, t in enumerate(titles):
        first.setdefault(frozenset(t), f"i{k:03d}")
    want = {(first[frozenset(t)], f"i{k:03d}") for k, t in enumerate(titles)}
    want |= {(min(i, j), max(i, j)) for (s, i), (t, j) in combinations(first.items(), 2) if 5 * len(s & t) >= 4 * len(s | t)}
    assert {(r[0], r[1]) for r in rows(registry.QUERIES["statement_jaccard_neardup"](spark, d))} == want


def test_hosts_of_many_neighbours(spark, tables):
    d = tables("kg_edges", [("r", "hub", f"n{k:02d}", 3, T0) for k in range(60)], "run_id string, a string, b string, papers int, built_at timestamp")
    assert rows(registry.QUERIES["detector_hosts"](spark, d)) == [("r", f"hub~n{k:02d}", "hub") for k in range(60)]

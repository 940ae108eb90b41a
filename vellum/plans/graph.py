"""Knowledge-graph queries over kg_mentions, kg_papers and kg_entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import graph as G
from vellum.plans.relational import KG_NEWEST
from vellum.sources.tables import newest, nodes_and_edges_json, table


TERMS = {
    "random forests": "METHOD:random forest", "decision forests": "METHOD:decision forest", "kernel methods": "METHOD:kernel method", "active learning": "METHOD:active learning", "transfer learning": "METHOD:transfer learning", "neural networks": "METHOD:neural network",
    "federated training": "METHOD:federated training", "gradient descent": "METHOD:gradient descent", "weight pruning": "METHOD:weight pruning", "representation learning": "METHOD:representation learning", "model ensembles": "METHOD:model ensemble",
    "image segmentation": "TASK:image segmentation", "image retrieval": "TASK:image retrieval", "visual odometry": "TASK:visual odometry", "dependency parsing": "TASK:dependency parsing", "hyperparameter search": "TASK:hyperparameter search", "class imbalance": "TASK:class imbalance",
    "gene expression": "CONCEPT:gene expression", "expression": "CONCEPT:expression",
}


def run_sizes(spark, d):
    return newest(table(spark, d, "kg_papers"), ["run_id", "paper_id"], "built_at").groupBy("run_id").agg(F.count("*").alias("n"))


def entity_paper(spark, d):
    return G.entity_papers(table(spark, d, "kg_mentions"))


def edges(spark, d):
    return G.cooccurrence(entity_paper(spark, d), run_sizes(spark, d))


def entity_mentions(spark, d):
    return G.rollup(entity_paper(spark, d), run_sizes(spark, d)).select("run_id", "entity", "papers", F.col("chunks").cast("long").alias("chunks"), "mentions", "generic")


def cooccurrence_pmi(spark, d):
    return edges(spark, d)


def same_type_siblings(spark, d):
    return G.siblings(edges(spark, d)).select("run_id", "a", "sibling", "shared", "rn")


def chunks_mentioning_all(spark, d):
    return G.chunks_mentioning_all(table(spark, d, "kg_mentions"), ["TASK:classification", "METRIC:misama7 score"])


def relevance_gate(spark, d):
    p = newest(table(spark, d, "kg_papers").select("run_id", "paper_id", "built_at", "relevance"), ["run_id", "paper_id"], "built_at")
    return G.relevance_gate(p).groupBy("run_id").agg(F.count("*").alias("papers"), F.sum(F.col("passes").cast("int")).alias("on_topic"), F.round(F.max("gate"), 6).alias("gate"))


def graph_communities(spark, d):
    return G.communities(edges(spark, d))


def _edge_kinds(all_edges):
    return all_edges.groupBy("run_id", "kind").agg(F.count("*").alias("edges"), F.sum("weight").cast("long").alias("weight"))


def graph_edge_kinds(spark, d):
    """Edges of the whole graph by kind, with communities, statements and claims."""
    e = edges(spark, d)
    return _edge_kinds(G.typed_edges(entity_paper(spark, d), e, G.communities(e), *evidence_nodes(spark, d)))


def graph_evidence_kinds(spark, d):
    """The kinds that don't depend on the partition into communities."""
    return _edge_kinds(G.typed_edges(entity_paper(spark, d), edges(spark, d), None, *evidence_nodes(spark, d)))


def evidence_nodes(spark, d):
    """Statements and claims, for which each newest chunk stands: its entities are what it is about, and a result if it names a metric."""
    m = G.newest_mentions(table(spark, d, "kg_mentions"))
    one = m.groupBy("run_id", F.col("chunk_id").alias("id"), "paper_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return one, one.filter(F.exists("entities", lambda x: x.startswith("METRIC:")))


def community_labels(spark, d):
    e = edges(spark, d)
    return G.community_labels(G.communities(e), entity_mentions(spark, d))


def cytoscape_elements(spark, d):
    nodes = table(spark, d, "kg_entities").select(F.col("entity_id").alias("id"), F.col("entity_type").alias("kind"), F.col("name").alias("label"))
    links = table(spark, d, "kg_edges").select(F.concat_ws("~", "run_id", "a", "b").alias("id"), F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    return nodes_and_edges_json(nodes, links)


def entity_tagger(spark, d):
    """Names of the entity table found in the texts of sections."""
    t = table(spark, d, "sections").dropDuplicates(["section_id"])
    return G.tag_entities(t, vocabulary(table(spark, d, "kg_entities")) | TERMS, "section_id")


def vocabulary(entities, most=200_000):
    """Names of an entity table to their ids; a table of more than ``most`` is no vocabulary and is refused."""
    rows = entities.filter("name is not null").groupBy("name").agg(F.min("entity_id").alias("id")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} names")
    return {r["name"]: r["id"] for r in rows}


EP_SQL = rf"""nm AS (SELECT run_id, chunk_id, m.p AS paper_id, m.c AS c, upper(trim(split_part(entity_id, ':', 1))) || ':' || CASE WHEN length(k) > 4 AND ends_with(k, 's') AND NOT ends_with(k, 'ss') THEN left(k, -1) ELSE k END AS entity FROM
  (SELECT run_id, chunk_id, entity_id, trim(regexp_replace(lower(entity_id[strpos(entity_id, ':') + 1:]), '[-_\s]+', ' ', 'g')) AS k, max(struct_pack(t := tagged_at, c := mention_count, p := paper_id)) AS m FROM kg_mentions GROUP BY run_id, chunk_id, entity_id)
  WHERE m.c >= 1),
ep AS (SELECT run_id, entity, paper_id, count(DISTINCT chunk_id) AS chunks, sum(c)::BIGINT AS mentions FROM nm GROUP BY run_id, entity, paper_id),
n AS (SELECT run_id, count(*) AS n FROM kp GROUP BY run_id),
f AS (SELECT run_id, entity, count(*) AS f FROM ep GROUP BY ALL),
pr AS (SELECT a.run_id, a.entity AS a, b.entity AS b, count(*) AS papers FROM ep a JOIN ep b ON a.run_id = b.run_id AND a.paper_id = b.paper_id AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2),
edge AS (SELECT pr.run_id, a, b, papers, round(log2(papers * n / (fa.f * fb.f)::DOUBLE), 4) AS pmi FROM pr JOIN n USING (run_id) JOIN f fa ON fa.run_id = pr.run_id AND fa.entity = a JOIN f fb ON fb.run_id = pr.run_id AND fb.entity = b)"""
BASE = f"WITH {KG_NEWEST}, {EP_SQL}"
QUERIES = {f.__name__: f for f in (entity_mentions, cooccurrence_pmi, same_type_siblings, chunks_mentioning_all, relevance_gate, graph_communities, graph_edge_kinds, graph_evidence_kinds, community_labels, cytoscape_elements, entity_tagger)}
ORACLES = {
    "entity_mentions": BASE + " SELECT run_id, entity, count(*) AS papers, sum(chunks)::BIGINT AS chunks, sum(mentions)::BIGINT AS mentions, count(*) >= 0.8 * max(n) AND max(n) >= 5 AS generic FROM ep JOIN n USING (run_id) GROUP BY run_id, entity",
    "cooccurrence_pmi": BASE + " SELECT * FROM edge",
    "same_type_siblings": BASE
    + """, s AS (SELECT * FROM edge WHERE pmi > 0.5 AND papers >= 3), w AS (SELECT run_id, a, b, papers FROM s UNION ALL SELECT run_id, b, a, papers FROM s),
j AS (SELECT x.run_id, x.a, y.a AS sibling, sum(least(x.papers, y.papers))::BIGINT AS shared FROM w x JOIN w y ON x.run_id = y.run_id AND x.b = y.b AND x.a <> y.a AND split_part(x.a, ':', 1) = split_part(y.a, ':', 1) GROUP BY ALL HAVING sum(least(x.papers, y.papers)) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, a ORDER BY shared DESC, sibling) AS rn FROM j) SELECT * FROM r WHERE rn <= 3""",
    "chunks_mentioning_all": """SELECT chunk_id, sum(c)::BIGINT AS mentions FROM (SELECT chunk_id, entity_id, max(mention_count) AS c FROM kg_mentions WHERE entity_id IN ('TASK:classification', 'METRIC:misama7 score') AND mention_count >= 1 GROUP BY ALL) GROUP BY chunk_id HAVING count(*) = 2""",
    "relevance_gate": """WITH p AS (SELECT run_id, paper_id, max(struct_pack(t := built_at, r := relevance)).r AS relevance FROM kg_papers GROUP BY ALL),
g AS (SELECT run_id, greatest(0.55, list_sort(list(relevance) FILTER (relevance IS NOT NULL))[count(relevance) // 2 + 1] - 0.08) AS gate FROM p GROUP BY run_id)
SELECT run_id, count(*) AS papers, sum(CASE WHEN relevance >= gate THEN 1 ELSE 0 END)::BIGINT AS on_topic, round(max(gate), 6) AS gate FROM p JOIN g USING (run_id) GROUP BY run_id""",
    "graph_evidence_kinds": BASE + """, cm AS (SELECT run_id, chunk_id, paper_id, list(DISTINCT entity) AS es FROM nm GROUP BY ALL), st AS (SELECT *, len(list_filter(es, lambda x: starts_with(x, 'METRIC:'))) > 0 AS result FROM cm)
SELECT run_id, 'MENTIONS' AS kind, count(*) AS edges, sum(chunks)::BIGINT AS weight FROM ep GROUP BY run_id UNION ALL SELECT run_id, 'CO_OCCURS', count(*), sum(papers)::BIGINT FROM edge GROUP BY run_id
UNION ALL SELECT run_id, 'STATES', count(*), count(*) FROM st GROUP BY run_id UNION ALL SELECT run_id, 'ABOUT', sum(len(es))::BIGINT, sum(len(es))::BIGINT FROM st GROUP BY run_id
UNION ALL SELECT run_id, 'REPORTS', count(*), count(*) FROM st WHERE result GROUP BY run_id UNION ALL SELECT run_id, 'ON', sum(len(es))::BIGINT, sum(len(es))::BIGINT FROM st WHERE result GROUP BY run_id""",
    "cytoscape_elements": """SELECT '{"data":' || json_object('id', entity_id, 'kind', entity_type, 'label', name) || '}' AS element FROM kg_entities UNION ALL
SELECT '{"data":' || json_object('id', concat_ws('~', run_id, a, b), 'source', a, 'target', b) || '}' FROM (SELECT DISTINCT run_id, a, b FROM kg_edges)""",
}

"""Queries on claims, later work, coverage and the joining of detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.text import sentences
from vellum.operators import evidence as E
from vellum.operators.graph import DATASET_NAME, NO_DATASET
from vellum.plans.graph import TERMS
from vellum.sources.tables import newest, table

GAPS = {"g1": ["gene expression", "soil bacteria"], "g2": ["household savings", "credit markets", "interest rates"], "g3": ["dark matter halos", "detector noise"], "g4": ["only one"]}


def result_claims(spark, d):
    """Claims of all documents: sentences with a direction that name a method and a task."""
    c = E.result_claims(table(spark, d, "documents").filter("text is not null"), "doc_id", TERMS)
    return c.groupBy("direction").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count("metric").alias("metrics"))


def claim_directions(spark, d):
    """Sentences with a direction, whatever they name."""
    c = E.result_claims(table(spark, d, "documents").filter("text is not null"), "doc_id")
    return c.groupBy("direction").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count("metric").alias("metrics"))


def statement_rejections(spark, d):
    s = table(spark, d, "documents").filter("text is not null").select(F.explode(sentences(F.col("text"))).alias("s"))
    return s.groupBy(F.coalesce(E.rejection(F.col("s")), F.lit("KEPT")).alias("rule")).agg(F.count("*").alias("n"))


def external_coverage(spark, d):
    return E.external_coverage(table(spark, d, "documents").select("text"), GAPS)


def detector_hosts(spark, d):
    """Edges of three papers as guests of every entity with its neighbours; a pair joins the first host that contains or resembles it."""
    e = newest(table(spark, d, "kg_edges").distinct(), ["run_id", "a", "b"], "built_at").select(F.col("run_id").alias("grp"), F.concat_ws("~", "a", "b").alias("name"), F.array("a", "b").alias("ab"), "papers", "a", "b")
    near = e.select("grp", F.col("a").alias("x"), "b").groupBy("grp", "x").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    hosts = near.select("grp", F.col("x").alias("host"), F.col("x").alias("place"), F.array_union(F.array("x"), "bs").alias("core"))
    return E.host_of(e.filter("papers >= 3").select("grp", F.col("name").alias("guest"), F.col("ab").alias("concepts")), hosts)


def addressed_later(spark, d):
    """For each stored pair of a run: later papers whose chunk mentions both, after the pair's first paper year."""
    years = newest(table(spark, d, "kg_papers").select("run_id", "paper_id", "built_at", "publication_year"), ["run_id", "paper_id"], "built_at").filter("publication_year > 0").select("run_id", "paper_id", F.col("publication_year").alias("year"))
    m = table(spark, d, "kg_mentions").filter("mention_count >= 1").select("run_id", "chunk_id", "paper_id", "entity_id").distinct().join(years, ["run_id", "paper_id"])
    # The last letter of a chunk's id stands for its section: one in eight isn't one that addresses anything.
    kind = F.when(F.col("chunk_id").rlike("[0a]$"), "REFERENCES").otherwise("RESULTS")
    chunks = m.select("chunk_id", "paper_id", "year", kind.alias("section_type"), F.concat_ws("|", "run_id", "entity_id").alias("entity"))
    first = years.groupBy("run_id").agg(F.min("year").alias("latest"))
    pairs = table(spark, d, "kg_edges").filter("a <> b").select("run_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(first, "run_id")
    gaps = pairs.select(F.concat_ws("|", "run_id", "a", "b").alias("gap_id"), F.array(F.concat_ws("|", "run_id", "a"), F.concat_ws("|", "run_id", "b")).alias("concepts"), "latest")
    # The papers of the first year that mention both state the gap.
    own = m.join(first.withColumnRenamed("latest", "first"), "run_id").filter("year <= first + 1").select("run_id", "paper_id", "entity_id").distinct()
    both = pairs.join(own.withColumnRenamed("entity_id", "a"), ["run_id", "a"]).join(own.withColumnRenamed("entity_id", "b"), ["run_id", "b", "paper_id"])
    return E.addressed_later(gaps, chunks, both.select(F.concat_ws("|", "run_id", "a", "b").alias("gap_id"), "paper_id"))


ENGLISH = r"""WITH t AS (SELECT doc_id, section_type, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, section_type, unnest(string_split(regexp_replace(x, '([.!?]) +([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS sentence FROM t)"""


CLAIMS_SQL = f"""c AS (SELECT DISTINCT ON (doc_id, lower(sentence)) doc_id, sentence, CASE WHEN regexp_matches(sentence, '{E.POSITIVE}') AND regexp_matches(sentence, '{E.NEGATIVE}') THEN 'MIXED' WHEN regexp_matches(sentence, '{E.POSITIVE}') THEN 'POSITIVE' WHEN regexp_matches(sentence, '{E.NEGATIVE}') THEN 'NEGATIVE' END AS direction
 FROM s WHERE upper(section_type) IN ('RESULTS', 'DISCUSSION', 'ABSTRACT'))"""


def _named(*kinds: str) -> str:
    return r"(?i)(^|[^\w-])(" + "|".join(t for t, e in TERMS.items() if e.split(":")[0] in kinds) + r")([^\w-]|$)"


_STOPS = ", ".join(f"'{w}'" for w in NO_DATASET)
_DATASETS = f"len(list_filter(regexp_extract_all(sentence, '{DATASET_NAME}', 1), lambda x: lower(string_split(x, ' ')[1]) NOT IN ({_STOPS}))) > 0"


def _coverage_sql() -> str:
    parts = []
    for g, ps in GAPS.items():
        if len(ps) > 1:
            each = [f"count(*) FILTER (contains(lower(text), '{p}'))" for p in ps]
            every = " AND ".join(f"contains(lower(text), '{p}')" for p in ps)
            parts.append(f"SELECT '{g}' AS gap_id, count(*) FILTER ({every}) AS joint, least({', '.join(each)}) AS smallest FROM documents")
    return f"SELECT *, round(joint / greatest(1, smallest)::DOUBLE, 4) AS coverage FROM ({' UNION ALL '.join(parts)})"


QUERIES = {f.__name__: f for f in (result_claims, claim_directions, statement_rejections, external_coverage, detector_hosts, addressed_later)}
ORACLES = {
    "claim_directions": ENGLISH + f""", {CLAIMS_SQL} SELECT direction, count(*) AS n, count(DISTINCT doc_id) AS docs, count(CASE WHEN regexp_matches(sentence, '{E.METRIC}') THEN 1 END) AS metrics FROM c WHERE direction IS NOT NULL GROUP BY direction""",
    "result_claims": ENGLISH + f""", {CLAIMS_SQL} SELECT direction, count(*) AS n, count(DISTINCT doc_id) AS docs, count(CASE WHEN regexp_matches(sentence, '{E.METRIC}') THEN 1 END) AS metrics FROM c
 WHERE direction IS NOT NULL AND regexp_matches(sentence, '{_named("METHOD")}') AND (regexp_matches(sentence, '{_named("TASK", "DATASET")}') OR {_DATASETS}) GROUP BY direction""",
    "external_coverage": _coverage_sql(),
    "detector_hosts": """WITH e AS (SELECT run_id AS grp, a, b, max(struct_pack(t := built_at, p := papers)).p AS papers FROM kg_edges GROUP BY ALL),
h AS (SELECT grp, a AS host, list_distinct(list_prepend(a, list(DISTINCT b))) AS core FROM e GROUP BY grp, a),
p AS (SELECT e.grp, e.a || '~' || e.b AS guest, host, core, len(list_intersect(core, [e.a, e.b])) AS i, CASE WHEN e.a = e.b THEN 1 ELSE 2 END AS k FROM e JOIN h USING (grp) WHERE e.papers >= 3)
SELECT grp, guest, min(host) AS host FROM p WHERE i = k OR (len(core) >= 2 AND i / (len(core) + k - i)::DOUBLE >= 0.6) GROUP BY grp, guest""",
    "addressed_later": """WITH y AS (SELECT run_id, paper_id, max(struct_pack(t := built_at, y := publication_year)).y AS year FROM kg_papers GROUP BY ALL), yy AS (SELECT * FROM y WHERE year > 0), f AS (SELECT run_id, min(year) AS latest FROM yy GROUP BY run_id),
m AS (SELECT DISTINCT k.run_id, chunk_id, paper_id, entity_id, year FROM kg_mentions k JOIN yy USING (run_id, paper_id) WHERE mention_count >= 1),
p AS (SELECT DISTINCT run_id, least(a, b) AS a, greatest(a, b) AS b, latest FROM kg_edges JOIN f USING (run_id) WHERE a <> b),
w AS (SELECT p.run_id || '|' || p.a || '|' || p.b AS gap_id, x.chunk_id, x.paper_id, x.year FROM p JOIN m x ON x.run_id = p.run_id AND x.entity_id = p.a JOIN m z ON z.run_id = p.run_id AND z.entity_id = p.b AND z.chunk_id = x.chunk_id WHERE x.year > latest AND NOT regexp_matches(x.chunk_id, '[0a]$') AND NOT (x.year <= latest + 1 AND EXISTS (SELECT 1 FROM m u WHERE u.run_id = p.run_id AND u.paper_id = x.paper_id AND u.entity_id = p.a) AND EXISTS (SELECT 1 FROM m u WHERE u.run_id = p.run_id AND u.paper_id = x.paper_id AND u.entity_id = p.b))),
o AS (SELECT *, row_number() OVER (PARTITION BY gap_id, paper_id ORDER BY chunk_id) AS c FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY gap_id ORDER BY year, chunk_id) AS r FROM o WHERE c = 1)
SELECT gap_id, chunk_id, paper_id, year FROM r WHERE r <= 5""",
}

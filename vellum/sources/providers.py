"""Records of literature providers and full texts: captured responses to papers, discovery, downloads, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import inverted_index_text

# Shapes of the two providers' answers and of the open-access lookup.
OPENALEX = "id string, title string, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>, publication_year int, primary_location struct<source:struct<display_name:string>>, doi string, open_access struct<is_oa:boolean,oa_status:string,oa_url:string>, cited_by_count int"
SEMANTIC_SCHOLAR = "paperId string, title string, authors array<struct<name:string>>, abstract string, year int, venue string, externalIds struct<DOI:string>, openAccessPdf struct<url:string,status:string>, citationCount int, url string"
UNPAYWALL = "doi string, is_oa boolean, best_oa_location struct<url_for_pdf:string,url:string>"
NO_TITLE = "(No title)"
MAX_BYTES = 20 * 1024 * 1024
COLUMNS = ["source", "provider_id", "title", "authors", "abstract", "publication_year", "venue", "doi", "paper_url", "full_text_url", "open_access_status", "citation_count"]


def _text(c: str | Column) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _names(names: Column) -> Column:
    return F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != "")


def openalex_papers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Papers of captured works, one JSON object a row; malformed rows and those without an object are skipped."""
    w = answers.withColumn("w", F.from_json(body, OPENALEX, {"mode": "PERMISSIVE"})).filter("w.id is not null or w.title is not null")
    link = F.trim(F.coalesce("w.id", F.lit("")))
    return w.select(
        F.lit("openalex").alias("source"), F.replace(link, F.lit("https://openalex.org/"), F.lit("")).alias("provider_id"), F.coalesce(_text("w.title"), F.lit(NO_TITLE)).alias("title"),
        _names(F.transform("w.authorships", lambda a: a["author"]["display_name"])).alias("authors"), F.coalesce(inverted_index_text(F.col("w.abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.col("w.publication_year").alias("publication_year"), _text("w.primary_location.source.display_name").alias("venue"), _text(F.replace(F.col("w.doi"), F.lit("https://doi.org/"), F.lit(""))).alias("doi"),
        F.when(link.startswith("http"), link).alias("paper_url"), _text("w.open_access.oa_url").alias("full_text_url"), _text("w.open_access.oa_status").alias("open_access_status"), F.col("w.cited_by_count").alias("citation_count"),
    )


def semantic_scholar_papers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Papers of captured answers, one JSON object a row; malformed rows are skipped."""
    w = answers.withColumn("w", F.from_json(body, SEMANTIC_SCHOLAR, {"mode": "PERMISSIVE"})).filter("w.paperId is not null or w.title is not null")
    return w.select(
        F.lit("semantic_scholar").alias("source"), F.coalesce("w.paperId", F.lit("")).alias("provider_id"), F.coalesce(_text("w.title"), F.lit(NO_TITLE)).alias("title"), _names(F.transform("w.authors", lambda a: a["name"])).alias("authors"),
        F.trim(F.coalesce("w.abstract", F.lit(""))).alias("abstract"), F.col("w.year").alias("publication_year"), _text("w.venue").alias("venue"), F.nullif("w.externalIds.DOI", F.lit("")).alias("doi"), F.nullif("w.url", F.lit("")).alias("paper_url"),
        F.nullif("w.openAccessPdf.url", F.lit("")).alias("full_text_url"), F.nullif("w.openAccessPdf.status", F.lit("")).alias("open_access_status"), F.col("w.citationCount").alias("citation_count"),
    )


def point_lookup(papers: DataFrame, provider_id: str) -> DataFrame:
    """The paper of an id, or no row."""
    return papers.filter(F.col("provider_id") == provider_id).limit(1)


def inverted_index_with_repeats(index: Column) -> Column:
    """Text of a map from words to positions, in order of position and word; words that share a position are all kept."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def discovered(papers: DataFrame, lookups: DataFrame) -> DataFrame:
    """Papers with ``best_url`` and ``url_source``: their own full-text link, else that of the lookup by DOI, else none.

    ``lookups``: (doi, body) of captured open-access answers; of several per DOI the first that has a link, in order of the answer.
    """
    u = lookups.withColumn("u", F.from_json("body", UNPAYWALL, {"mode": "PERMISSIVE"}))
    link = F.when(F.col("u.is_oa"), F.coalesce(F.nullif("u.best_oa_location.url_for_pdf", F.lit("")), F.nullif("u.best_oa_location.url", F.lit(""))))
    u = u.select("doi", "body", link.alias("oa_url")).filter("oa_url is not null").groupBy("doi").agg(F.min_by("oa_url", "body").alias("oa_url"))
    own = F.nullif("full_text_url", F.lit(""))
    j = papers.join(u, "doi", "left")
    return j.withColumn("best_url", F.coalesce(own, "oa_url")).withColumn("url_source", F.when(own.isNotNull(), F.col("source_type")).when(F.col("oa_url").isNotNull(), "unpaywall")).drop("oa_url")


def download_status(url: Column, code: Column, content_type: Column, size: Column) -> Column:
    """Status of a full text after its download: NO_OA_FOUND, DOWNLOAD_FAILED, INVALID_DOCUMENT or DOWNLOADED."""
    pdf = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf"))
    return F.when(url.isNull(), "NO_OA_FOUND").when(code.isNull() | (code != 200), "DOWNLOAD_FAILED").when(~pdf | size.isNull() | (size == 0) | (size > MAX_BYTES), "INVALID_DOCUMENT").otherwise("DOWNLOADED")


def artifact_path(paper: Column, name: str) -> Column:
    return F.concat(F.lit("papers/"), paper, F.lit(f"/{name}"))


def paper_of_path(path: Column) -> Column:
    """The paper of an artifact's path; a doubled folder in front counts once; null for other paths."""
    parts = F.split(F.regexp_replace(path, "^papers/papers/", "papers/"), "/")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "papers"), F.get(parts, F.lit(1)))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a GraphML document as lines in order of (part, line), to be written as text: head, nodes, edges, tail.

    ``nodes``: (id, kind, label); ``edges``: (src, dst, kind, weight). Repeated nodes come once.
    """
    def escape(c):
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="kind" for="all" attr.name="kind" attr.type="string"/><key id="label" for="node" attr.name="label" attr.type="string"/><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    frame = nodes.sparkSession.createDataFrame([(0, head), (3, "</graph></graphml>")], "part int, line string")
    n = nodes.groupBy("id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"))
    n = n.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), escape("id"), F.lit('"><data key="kind">'), escape("kind"), F.lit('</data><data key="label">'), escape("label"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), escape("src"), F.lit('" target="'), escape("dst"), F.lit('"><data key="kind">'), escape("kind"), F.lit('</data><data key="weight">'), escape("weight"), F.lit("</data></edge>")).alias("line"))
    return frame.unionByName(n).unionByName(e)

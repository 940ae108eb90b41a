"""Knowledge graph: mentions, co-occurrence, entity forms, communities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import term_key

# Pairs of entity types whose rare combination may be a gap.
TYPE_PAIRS = [("METHOD", "MODALITY"), ("METHOD", "DISEASE"), ("METHOD", "DATASET"), ("METHOD", "TASK"), ("METHOD", "POPULATION"), ("MODALITY", "DISEASE"), ("DISEASE", "POPULATION"), ("METHOD", "CONCEPT")]
# A name in front of "dataset", and words that are no name there.
DATASET_NAME = r"\b([A-Z][A-Za-z0-9\-_]{2,}(?:[ -][A-Z0-9][A-Za-z0-9\-_]*)?)\s+(?:dataset|database|data set)s?\b"
NO_DATASET = (
    "this the our their each every a an public publicly large small same new proposed test training validation image images medical available open private benchmark whole entire full original used "
    "second first third different other two three both following clinical retinal fundus oct eye kaggle own custom combined"
).split()
# Entity types of the fields of an understood question.
FIELD_TYPES = {"methods": "METHOD", "method_variants": "METHOD", "datasets": "DATASET", "metrics": "METRIC", "entities": "DISEASE", "concepts": "CONCEPT", "terminology_variants": "CONCEPT", "constraints": "POPULATION"}


def newest_mentions(mentions: DataFrame) -> DataFrame:
    """(run_id, chunk_id, paper_id, entity, c): the newest mention of each chunk and id as written, of at least one; entities in their plain form."""
    newest = mentions.groupBy("run_id", "chunk_id", "entity_id").agg(F.max(F.struct("tagged_at", "mention_count", "paper_id")).alias("m")).filter("m.mention_count >= 1")
    plain = F.concat_ws(":", F.upper(F.trim(F.element_at(F.split("entity_id", ":", 2), 1))), term_key(F.element_at(F.split("entity_id", ":", 2), 2)))
    return newest.select("run_id", "chunk_id", F.col("m.paper_id").alias("paper_id"), plain.alias("entity"), F.col("m.mention_count").alias("c"))


def entity_papers(mentions: DataFrame) -> DataFrame:
    """(run_id, entity, paper_id, chunks, mentions) of the newest mentions."""
    return newest_mentions(mentions).groupBy("run_id", "entity", "paper_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.sum("c").cast("long").alias("mentions"))


def rollup(entity_paper: DataFrame, papers_of_run: DataFrame) -> DataFrame:
    """Per run and entity: papers, chunks, mentions, and whether it is generic: in 80 % of the papers of a run of five or more."""
    r = entity_paper.groupBy("run_id", "entity").agg(F.count("*").alias("papers"), F.sum("chunks").alias("chunks"), F.sum("mentions").alias("mentions"))
    return r.join(papers_of_run, "run_id").withColumn("generic", (F.col("papers") >= 0.8 * F.col("n")) & (F.col("n") >= 5))


def cooccurrence(entity_paper: DataFrame, papers_of_run: DataFrame, least: int = 2) -> DataFrame:
    """(run_id, a, b, papers, pmi) of pairs in ``least`` papers or more.

    Entities of fewer papers can't reach that and are left out before the join,
    which pairs the entities within a paper; counts are partial before the shuffle.
    """
    freq = entity_paper.groupBy("run_id", "entity").agg(F.count("*").alias("f")).filter(F.col("f") >= least)
    rows = entity_paper.join(freq, ["run_id", "entity"]).select("run_id", "paper_id", "entity", "f")
    other = rows.select("run_id", "paper_id", F.col("entity").alias("b"), F.col("f").alias("fb"))
    pairs = rows.join(other, ["run_id", "paper_id"]).filter("entity < b").groupBy("run_id", F.col("entity").alias("a"), "b").agg(F.count("*").alias("papers"), F.max("f").alias("fa"), F.max("fb").alias("fb"))
    out = pairs.filter(F.col("papers") >= least).join(papers_of_run, "run_id")
    return out.select("run_id", "a", "b", "papers", F.round(F.log2(F.col("papers") * F.col("n") / (F.col("fa") * F.col("fb"))), 4).alias("pmi"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("run_id", F.col("b").alias("a"), F.col("a").alias("b"), "papers", "pmi"))


def siblings(edges: DataFrame, least_shared: int = 2) -> DataFrame:
    """(run_id, a, sibling, shared): entities of one type ranked by the papers they share through common neighbours.

    Neighbours are kept by positive pmi, so the join on a neighbour stays short.
    """
    strong = both_ways(edges.filter("pmi > 0.5 and papers >= 3"))
    left = strong.select("run_id", "a", F.col("b").alias("via"), F.col("papers").alias("p"))
    right = strong.select("run_id", F.col("a").alias("sibling"), F.col("b").alias("via"), F.col("papers").alias("q"))
    kind = lambda c: F.element_at(F.split(c, ":"), 1)
    j = left.join(right, ["run_id", "via"]).filter((F.col("a") != F.col("sibling")) & (kind("a") == kind("sibling")))
    out = j.groupBy("run_id", "a", "sibling").agg(F.sum(F.least("p", "q")).alias("shared")).filter(F.col("shared") >= least_shared)
    w = Window.partitionBy("run_id", "a").orderBy(F.desc("shared"), "sibling")
    return out.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")


def chunks_mentioning_all(mentions: DataFrame, entities: list[str]) -> DataFrame:
    """(chunk_id, mentions) of chunks that mention every entity, most mentions first."""
    rows = mentions.filter(F.col("entity_id").isin(entities) & (F.col("mention_count") >= 1)).groupBy("chunk_id", "entity_id").agg(F.max("mention_count").alias("c"))
    return rows.groupBy("chunk_id").agg(F.count("*").alias("k"), F.sum("c").cast("long").alias("mentions")).filter(F.col("k") == len(set(entities))).select("chunk_id", "mentions")


def question_terms(understanding: dict[str, list[str] | None], vocabulary: dict[str, str]) -> dict[str, str]:
    """``vocabulary`` with the terms of an understood question: of 3 to 60 characters, never in place of a known form."""
    known = {f.lower() for f in vocabulary if not f.startswith("=")}
    out = dict(vocabulary)
    for field, kind in FIELD_TYPES.items():
        for term in understanding.get(field) or []:
            t = (term or "").strip()
            if 3 <= len(t) <= 60 and t.lower() not in known:
                out[t], _ = f"{kind}:{t.lower()}", known.add(t.lower())
    return out


class Tagger:
    """Finds whole-word forms of a vocabulary; of spans that overlap the longest counts, then the earliest.

    ``vocabulary`` maps forms to entity ids; a form that begins with "=" is matched in its own case. With
    ``datasets``, a capitalised name in front of "dataset" is one too.
    """

    def __init__(self, vocabulary: dict[str, str], datasets: bool = True):
        self.any, self.own = {}, {}
        for form, entity in vocabulary.items():
            (self.own if form[:1] == "=" else self.any).setdefault(form[1:] if form[:1] == "=" else form.lower(), entity)
        whole = lambda forms, flags: re.compile(r"(?<![\w-])(?:" + "|".join(map(re.escape, sorted(forms, key=len, reverse=True))) + r")(?![\w-])", flags) if forms else None
        self.patterns = [(whole(self.any, re.IGNORECASE), lambda t: self.any.get(t.lower())), (whole(self.own, 0), self.own.get)]
        self.name = re.compile(DATASET_NAME) if datasets else None

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]:
        """(entity, surface, start, end) in order of the text."""
        spans = [(m.start(), m.end(), e, m[0]) for pattern, of in self.patterns if pattern for m in pattern.finditer(text) if (e := of(m[0]))]
        for m in self.name.finditer(text) if self.name else ():
            if m[1].split()[0].lower() not in NO_DATASET and m[1].lower() not in self.any:
                spans.append((m.start(1), m.end(1), f"DATASET:{m[1].lower()}", m[1]))
        kept: list[tuple[int, int, str, str]] = []
        for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
                kept.append(s)
        return [(e, surface, a, b) for a, b, e, surface in sorted(kept)]


def tag_entities(chunks: DataFrame, vocabulary: dict[str, str], chunk: str = "chunk_id", text: str = "text", datasets: bool = True) -> DataFrame:
    """(chunk, entity_id, mention_count, surfaces): mentions by Tagger. ``vocabulary`` is a parameter of a known size.

    Null texts have no mention; repeated rows of a chunk give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(vocabulary, datasets)
        for pdf in batches:
            rows = []
            for cid, t in zip(pdf._c, pdf._t):
                found: dict[str, list[str]] = {}
                for entity, surface, _, _ in tagger(t or ""):
                    found.setdefault(entity, []).append(surface)
                rows += [(cid, e, len(x), sorted(set(x))) for e, x in found.items()]
            yield pd.DataFrame(rows, columns=[chunk, "entity_id", "mention_count", "surfaces"])

    kind = dict(chunks.dtypes)[chunk]
    return chunks.select(F.col(chunk).alias("_c"), F.col(text).alias("_t")).mapInPandas(run, f"{chunk} {kind}, entity_id string, mention_count int, surfaces array<string>")


def canonical_forms(entities: DataFrame, least: float = 0.88) -> DataFrame:
    """(type, name, canonical): names of one type that are one by their plain form or by vectors of cosine ``least``.

    Greedy, most papers first, ties by name: a name joins the first leader it equals, else leads itself; two curated
    names never become one. Names meet within their type; an entity table is a vocabulary of a known size, no corpus.
    Null vectors equal none; repeated names are one row.
    """

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["papers", "name"], ascending=[False, True], kind="stable")
        size = max((len(v) for v in pdf.embedding if v is not None), default=1)
        x = np.zeros((len(pdf), size))
        for k, v in enumerate(pdf.embedding):
            if v is not None and len(v) == size:
                x[k] = np.asarray(v, float) / (np.linalg.norm(v) or 1)
        keys, curated = pdf.key.to_numpy(object), pdf.curated.to_numpy(bool)
        leaders = np.empty(len(pdf), int)
        owner, n = np.empty(len(pdf), int), 0
        for k in range(len(pdf)):
            held = leaders[:n]
            same = ((x[held] @ x[k] >= least) | (keys[held] == keys[k])) & ~(curated[held] & curated[k])
            hit = int(same.argmax()) if n and same.any() else -1
            owner[k] = held[hit] if hit >= 0 else k
            if hit < 0:
                leaders[n] = k
                n += 1
        names = pdf.name.to_numpy(object)
        return pd.DataFrame({"type": pdf.type, "name": names, "canonical": names[owner]})

    one = entities.groupBy("type", "name").agg(F.max("papers").alias("papers"), F.max(F.coalesce("curated", F.lit(False))).alias("curated"), F.first("embedding", ignorenulls=True).alias("embedding"))
    return one.withColumn("key", term_key(F.col("name"))).groupBy("type").applyInPandas(lead, "type string, name string, canonical string")


def canonical_mentions(mentions: DataFrame, forms: DataFrame) -> DataFrame:
    """(chunk_id, paper_id, entity, mention_count, surfaces): mentions under their canonical entity, counts added and surfaces joined.

    ``mentions``: (chunk_id, paper_id, entity_id "TYPE:name", mention_count, surfaces); ``forms``: (type, name, canonical).
    """
    kind, name = F.element_at(F.split("entity_id", ":", 2), 1), F.element_at(F.split("entity_id", ":", 2), 2)
    m = mentions.withColumn("type", kind).withColumn("name", name).join(forms, ["type", "name"], "left")
    m = m.withColumn("entity", F.concat_ws(":", "type", F.coalesce("canonical", "name")))
    return m.groupBy("chunk_id", "paper_id", "entity").agg(F.sum("mention_count").cast("long").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("surfaces")))).alias("surfaces"))


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(run_id, entity, community): modularity communities of each run's edges of two papers or more and positive pmi.

    A run's graph has at most its entities' pairs and is worked by one task, all
    runs side by side. Communities are numbered by size, then least member; those
    of one entity are left out.
    """

    def louvain(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.a) | set(pdf.b))
        at = {n: i for i, n in enumerate(names)}
        links = [(at[a], at[b], w) for a, b, w in zip(pdf.a, pdf.b, pdf.papers * pdf.pmi)]
        member = _louvain(len(names), links, resolution, seed)
        groups = pd.Series(names).groupby(member).apply(list)
        kept = sorted((g for g in groups if len(g) > 1), key=lambda g: (-len(g), g[0]))
        rows = [(pdf.run_id.iloc[0], e, k) for k, g in enumerate(kept) for e in g]
        return pd.DataFrame(rows, columns=["run_id", "entity", "community"])

    strong = edges.filter("papers >= 2 and pmi > 0").select("run_id", "a", "b", "papers", "pmi")
    return strong.groupBy("run_id").applyInPandas(louvain, "run_id string, entity string, community int")


def _louvain(n: int, links: list[tuple[int, int, float]], resolution: float, seed: int) -> np.ndarray:
    """Moves nodes to the neighbouring community of most gain, then merges communities to nodes, until nothing moves."""
    rng = np.random.default_rng(seed)
    member = np.arange(n)
    weights: dict[tuple[int, int], float] = {}
    for a, b, w in links:
        weights[min(a, b), max(a, b)] = weights.get((min(a, b), max(a, b)), 0.0) + w
    total = sum(weights.values())
    if not total:
        return member
    while True:
        size = member.max() + 1
        near: list[dict[int, float]] = [{} for _ in range(size)]
        degree = np.zeros(size)
        for (a, b), w in weights.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        own, load = np.arange(size), degree.copy()
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in rng.permutation(size):
                to: dict[int, float] = {}
                for u, w in near[v].items():
                    to[own[u]] = to.get(own[u], 0) + w
                load[own[v]] -= degree[v]
                gain = lambda c: to.get(c, 0.0) - resolution * degree[v] * load[c] / (2 * total)  # noqa: B023, E731
                best = max(sorted({own[v], *to}), key=lambda c: (gain(c), c == own[v]))
                if gain(best) <= gain(own[v]) + 1e-12:
                    best = own[v]
                load[best] += degree[v]
                if best != own[v]:
                    own[v], moved, moved_any = best, True, True
        _, own = np.unique(own, return_inverse=True)
        member = own[member]
        if not moved_any:
            return member
        merged: dict[tuple[int, int], float] = {}
        for (a, b), w in weights.items():
            key = (min(own[a], own[b]), max(own[a], own[b]))
            merged[key] = merged.get(key, 0.0) + w
        weights = merged


def community_labels(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(run_id, community, size, label): the names of a community's three entities of most papers."""
    j = groups.join(entities.select("run_id", "entity", "papers"), ["run_id", "entity"]).withColumn("name", F.element_at(F.split("entity", ":", 2), 2))
    r = j.withColumn("r", F.row_number().over(Window.partitionBy("run_id", "community").orderBy(F.desc("papers"), "entity")))
    return r.groupBy("run_id", "community").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "name")))), lambda x: x["name"]), ", ").alias("label"))


def typed_edges(entity_paper: DataFrame, edges: DataFrame, groups: DataFrame | None = None, statements: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """(run_id, src, dst, kind, weight) of the whole graph: MENTIONS, CO_OCCURS, IN_COMMUNITY, and STATES, ABOUT, REPORTS, ON.

    ``statements`` and ``claims``: (run_id, id, paper_id, entities). Edges to entities that the run doesn't have are left out.
    """
    edge = lambda df, src, dst, kind, weight=F.lit(1.0): df.select("run_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), weight.cast("double").alias("weight"))
    paper = F.concat(F.lit("paper:"), F.col("paper_id"))
    out = edge(entity_paper, paper, F.col("entity"), "MENTIONS", F.col("chunks"))
    out = out.unionByName(edge(edges.filter("papers >= 2"), F.col("a"), F.col("b"), "CO_OCCURS", F.col("papers")))
    if groups is not None:
        out = out.unionByName(edge(groups, F.col("entity"), F.concat(F.lit("community:"), F.col("community")), "IN_COMMUNITY"))
    known = entity_paper.select("run_id", "entity").distinct()
    for rows, node, of, about in ((statements, "statement", "STATES", "ABOUT"), (claims, "result_claim", "REPORTS", "ON")):
        if rows is not None:
            name = F.concat(F.lit(f"{node}:"), F.col("id"))
            out = out.unionByName(edge(rows, paper, name, of))
            out = out.unionByName(edge(rows.select("run_id", "id", F.explode("entities").alias("entity")).distinct().join(known, ["run_id", "entity"]), name, F.col("entity"), about))
    return out


def paper_relevance(papers: DataFrame, questions: DataFrame, embed, text: str = "text", fixed: float | None = None) -> DataFrame:
    """Papers (run_id, paper_id, title, body) with ``relevance`` and ``on_topic``: cosine of their text with the centroid of the run's questions.

    ``questions``: (run_id, question), blank ones left out; ``embed``: (DataFrame, text column) -> DataFrame with
    ``embedding``. A paper's text is its title and the first 1,500 characters of its body. Without ``fixed`` the threshold
    is that of relevance_gate; 0 lets all pass.
    """
    from vellum.functions.scores import cosine
    from vellum.operators.signals import centroids

    asked = embed(questions.filter(F.trim("question") != ""), "question")
    centre = centroids(asked, ["run_id"])
    p = papers.withColumn(text, F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("body", F.lit("")), 1, 1500)))
    scored = embed(p, text).join(centre, "run_id").withColumn("relevance", F.round(cosine(F.col("embedding"), F.col("centroid")), 4)).drop("embedding", "centroid", text)
    if fixed is not None:
        return scored.withColumn("on_topic", F.col("relevance") >= fixed)
    return relevance_gate(scored).withColumnRenamed("passes", "on_topic")


def relevance_gate(papers: DataFrame, margin: float = 0.08, floor: float = 0.55) -> DataFrame:
    """Adds ``gate`` and ``passes``: relevance of at least max(floor, upper median of the run - margin).

    The upper median is the value in the middle by a counted rank: no run's values are gathered in an array.
    """
    w = Window.partitionBy("run_id").orderBy("relevance", "paper_id")
    r = papers.filter("relevance is not null").withColumn("i", F.row_number().over(w))
    n = r.groupBy("run_id").agg(F.count("*").alias("n"))
    middle = r.join(n, "run_id").filter(F.col("i") == F.floor(F.col("n") / 2) + 1).select("run_id", F.greatest(F.lit(floor), F.col("relevance") - margin).alias("gate"))
    return papers.join(middle, "run_id", "left").withColumn("passes", F.coalesce(F.col("relevance") >= F.col("gate"), F.lit(False)))

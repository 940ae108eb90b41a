"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import materialise


def _signature(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], int(r["h"] or 0)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; the component is its least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) as joins
    with minima, each written to the shared folder: a node of any degree is
    handled by skew-aware joins, never gathered in one task. Links with a null
    end are ignored, a link of a node with itself yields its own component,
    repeated links count once, an empty table gives an empty result.
    """
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = materialise(clean.select(F.col("u").alias("node")).union(clean.select(F.col("v"))).distinct(), "nodes")
    edges = materialise(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _signature(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialise(edges, "star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(hung.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "star")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))

"""Items that appear together more often than chance.

Exact counts of pairs per group (a run), compared with a bipartite configuration
model fitted to the group: an item of degree d is in a basket of size s with
probability x(d) y(s) / (1 + x(d) y(s)), so that every item's frequency and every
basket's size hold in expectation. The number of baskets that hold both items of
a pair is then Poisson-binomial; its upper tail is the pair's p-value, and the
Benjamini-Hochberg rule over all pairs of the group's items gives q-values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.arrow import runs, whole_groups
from vellum.session import materialise, within_bytes

PAIRS_AT_ONCE = 1 << 22
LONGEST_EXACT = 2000  # joint counts above this use the normal approximation with a skewness term
BROADCAST_BYTES = 8 << 20
INCIDENCES_A_TASK = 50_000


def pair_counts(codes: np.ndarray, offsets: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) with a < b for baskets of distinct, ascending codes."""
    total_key, total_n = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal total_key, total_n, held, size
        key, n = np.unique(np.concatenate([*held, total_key]), return_inverse=True)
        weights = np.ones(len(n), np.int64)
        weights[len(n) - len(total_key) :] = total_n
        total_n = np.bincount(n, weights=weights).astype(np.int64)
        total_key, held, size = key, [], 0

    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        basket = codes[a:b]
        k = len(basket)
        step = max(1, PAIRS_AT_ONCE // max(k, 1))
        for s in range(0, k - 1, step):  # a block of first items at a time
            i = np.arange(s, min(s + step, k - 1))
            n = k - 1 - i
            first = np.repeat(i, n)
            second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first + 1
            held.append(basket[first] * n_items + basket[second])
            size += len(first)
            if size >= PAIRS_AT_ONCE:
                flush()
    if held:
        flush()
    return total_key // n_items, total_key % n_items, total_n


def fit_null(degree: np.ndarray, n_degree: np.ndarray, size: np.ndarray, n_size: np.ndarray, rounds: int = 2000, tolerance: float = 1e-8) -> np.ndarray:
    """Probabilities [degree class, size class] of the bipartite configuration model, by fixed-point rounds."""
    total = float((degree * n_degree).sum())
    x = degree / math.sqrt(total)
    y = size / math.sqrt(total)
    for _ in range(rounds):
        nx = np.minimum(degree / np.maximum((n_size * y / (1 + x[:, None] * y)).sum(1), 1e-300), 1e12)
        ny = np.minimum(size / np.maximum((n_degree[:, None] * nx[:, None] / (1 + nx[:, None] * y)).sum(0), 1e-300), 1e12)
        moved = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max())
        x, y = nx, ny
        if moved < tolerance:
            break
    p = x[:, None] * y
    return p / (1 + p)


def upper_tails(p: np.ndarray, n_size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """P(X >= least[i]) of Poisson-binomial X with n_size[k] trials of probability p[i, k]; each by itself exact up to LONGEST_EXACT."""
    out = np.ones(len(p))
    large = least > LONGEST_EXACT
    if large.any() and not large.all():
        out[large], out[~large] = upper_tails(p[large], n_size, least[large]), upper_tails(p[~large], n_size, least[~large])
        return out
    top = int(min(least.max(initial=0) + 40, n_size.sum()))
    if large.any():
        mean, var = p @ n_size, (p * (1 - p)) @ n_size
        sd = np.sqrt(np.maximum(var, 1e-300))
        z = (least - 0.5 - mean) / sd
        skew = (p * (1 - p) * (1 - 2 * p)) @ n_size / sd**3
        erfc = np.vectorize(math.erfc)
        return np.clip(0.5 * erfc(z / math.sqrt(2)) - skew * (1 - z**2) * np.exp(-(z**2) / 2) / (6 * math.sqrt(2 * math.pi)), 0, 1)
    for a in range(0, len(p), 4096):
        part, need = p[a : a + 4096], least[a : a + 4096]
        pmf = np.zeros((len(part), top + 2))  # the last cell gathers all above
        pmf[:, 0] = 1
        for k, m in enumerate(n_size.astype(int).tolist()):
            q = part[:, k : k + 1]
            if m <= 4 * top:
                for _ in range(m):
                    moved = pmf * q
                    pmf -= moved
                    pmf[:, 1:] += moved[:, :-1]
                    pmf[:, -1] += moved[:, -1]
            else:  # all trials of the class at once: a binomial
                j = np.arange(top + 1)
                log_c = math.lgamma(m + 1) - np.array([math.lgamma(i + 1) + math.lgamma(m - i + 1) for i in j])
                with np.errstate(divide="ignore"):
                    b = np.exp(log_c + j * np.log(np.maximum(q, 1e-300)) + (m - j) * np.log1p(-np.minimum(q, 1 - 1e-16)))
                new = np.zeros_like(pmf)
                for i in range(top + 1):
                    new[:, i : top + 1] += pmf[:, : top + 1 - i] * b[:, i : i + 1]
                new[:, -1] = np.maximum(1 - new[:, :-1].sum(1), 0)
                pmf = new
        tail = np.cumsum(pmf[:, ::-1], axis=1)[:, ::-1]
        out[a : a + 4096] = np.take_along_axis(tail, need[:, None].astype(np.int64), 1)[:, 0]
    return np.clip(out, 0, 1)


def adjusted(p: np.ndarray, weight: np.ndarray, tests: float) -> np.ndarray:
    """Benjamini-Hochberg q-values; ``weight``: tests that share each p; tests beyond them have p = 1."""
    order = np.argsort(p, kind="stable")
    ranked = p[order]
    upto = np.cumsum(weight[order])
    last = np.searchsorted(ranked, ranked, side="right") - 1  # ties share the last rank
    q = np.minimum.accumulate((ranked * tests / upto[last])[::-1])[::-1]
    out = np.empty_like(q)
    out[order] = np.minimum(q, 1)
    return out


def surprise(n_a: np.ndarray, n_b: np.ndarray, n_ab: np.ndarray, weight: np.ndarray, degree: np.ndarray, n_degree: np.ndarray, size: np.ndarray, n_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected, p, q) for pairs given by their items' degrees, from the group's histograms."""
    prob = fit_null(degree.astype(float), n_degree.astype(float), size.astype(float), n_size.astype(float))
    lo, hi = np.searchsorted(degree, np.minimum(n_a, n_b)), np.searchsorted(degree, np.maximum(n_a, n_b))
    classes, inverse = np.unique(np.stack([lo, hi, n_ab]), axis=1, return_inverse=True)
    both = prob[classes[0]] * prob[classes[1]]
    p = upper_tails(both, n_size, classes[2])[inverse.ravel()]
    items = float(n_degree.sum())
    return (both @ n_size)[inverse.ravel()], p, adjusted(p, weight, items * (items - 1) / 2)


PAIR_SCHEMA = "item_a string, item_b string, n_ab long, n_a long, n_b long, n long, expected double, p_value double, q_value double"


def pairs_in_groups(baskets: DataFrame, group_incidences: int = 4_000_000) -> DataFrame:
    """(grp, item_a, item_b, n_ab, n_a, n_b, n, expected, p_value, q_value) of every pair that occurs together.

    ``baskets``: (grp, n, items): one row per basket, ``items`` an array of
    distinct non-null strings, ``n`` the group's number of baskets including
    those without items. item_a < item_b in string order. A group of at most
    ``group_incidences`` incidences is worked by one task; a larger one is cut into
    slices of baskets whose counts are added, with the model fitted to its
    histograms. Empty baskets and baskets of one item give no pair; an empty
    table gives an empty result. ``n`` is handed on for lift: n_ab n / (n_a n_b).
    """
    baskets = materialise(baskets.select("grp", F.col("n").cast("long").alias("n"), "items"), "baskets")
    sizes = materialise(baskets.groupBy("grp").agg(F.sum(F.size("items")).cast("long").alias("inc")), "sizes")
    few = sizes.filter(F.col("inc") <= group_incidences)
    work = few.agg(F.sum("inc")).first()[0] or 0
    small = baskets.join(few.select("grp"), "grp", "left_semi")
    large = sizes.filter(F.col("inc") > group_incidences).select("grp", F.ceil(F.col("inc") / group_incidences).cast("int").alias("slices"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "grp", 1000):
            table = table.combine_chunks()
            keys = table.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
            for a, b in runs(keys):
                part = table.slice(a, b - a)
                lists = part.column("items").combine_chunks()
                names, codes, offsets = _codes(lists)
                if not len(names):
                    continue
                i, j, n_ab = pair_counts(codes, offsets, len(names))
                if not len(i):
                    continue
                freq = np.bincount(codes, minlength=len(names))
                degree, n_degree = np.unique(freq, return_counts=True)
                size, n_size = np.unique(np.diff(offsets)[np.diff(offsets) > 0], return_counts=True)
                expected, p, q = surprise(freq[i], freq[j], n_ab, np.ones(len(i)), degree, n_degree, size, n_size)
                k, n = len(i), part.column("n")[0].as_py()
                columns = [pa.array([part.column("grp")[0].as_py()] * k, pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), *map(pa.array, (n_ab, freq[i], freq[j], np.full(k, n), expected, p, q))]
                for c in range(0, k, 100_000):
                    yield pa.RecordBatch.from_arrays([x.slice(c, 100_000) for x in columns], names=["grp", *[x.split()[0] for x in PAIR_SCHEMA.split(", ")]])

    # By the work, not the bytes, which are few: a group's pairs are many times its incidences.
    tasks = min(100_000, max(1, -(-work // INCIDENCES_A_TASK)))
    out = small.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(whole, f"grp string, {PAIR_SCHEMA}")
    if large.isEmpty():
        return out
    return out.unionByName(_pairs_of_large(baskets.join(large, "grp")))


def _codes(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(sorted names, codes ascending within each basket, offsets)."""
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
    basket = np.repeat(np.arange(len(lists)), np.diff(offsets))
    return names.take(pa.array(order)), codes[np.lexsort((codes, basket))], offsets


def _pairs_of_large(baskets: DataFrame) -> DataFrame:
    # By a number of the row, so that equal baskets are spread too.
    cut = baskets.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.col("slices")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 1000):
            table = table.combine_chunks()
            keys = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            for a, b in runs(keys):
                names, codes, offsets = _codes(table.column("items").combine_chunks().slice(a, b - a))
                i, j, n_ab = pair_counts(codes, offsets, len(names))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([table.column("grp")[a].as_py()] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(n_ab)], names=["grp", "item_a", "item_b", "n_ab"])

    keyed = cut.withColumn("key", F.concat_ws("/", "grp", F.col("slice").cast("string"))).select("key", "grp", "items")
    pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(count, "grp string, item_a string, item_b string, n_ab long")
    pairs = pairs.groupBy("grp", "item_a", "item_b").agg(F.sum("n_ab").alias("n_ab"))
    freq = materialise(baskets.select("grp", F.explode("items").alias("item")).groupBy("grp", "item").agg(F.count("*").alias("f")), "frequencies")
    pairs = pairs.join(freq.select("grp", F.col("item").alias("item_a"), F.col("f").alias("n_a")), ["grp", "item_a"])
    pairs = materialise(pairs.join(freq.select("grp", F.col("item").alias("item_b"), F.col("f").alias("n_b")), ["grp", "item_b"]), "pairs")
    classes = pairs.groupBy("grp", F.least("n_a", "n_b").alias("lo"), F.greatest("n_a", "n_b").alias("hi"), "n_ab").agg(F.count("*").alias("w"))
    one = F.lit(0).cast("long")
    rows = (
        classes.withColumn("kind", F.lit("pair"))
        .unionByName(freq.groupBy("grp", F.col("f").alias("lo")).agg(F.count("*").alias("w")).select("grp", "lo", one.alias("hi"), one.alias("n_ab"), "w", F.lit("item").alias("kind")))
        .unionByName(baskets.filter(F.size("items") > 0).groupBy("grp", F.size("items").cast("long").alias("lo")).agg(F.count("*").alias("w")).select("grp", "lo", one.alias("hi"), one.alias("n_ab"), "w", F.lit("basket").alias("kind")))
    )

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = {k: g.sort_values("lo") for k, g in pdf.groupby("kind")}
        c = hist["pair"] if "pair" in hist else pdf.head(0)
        expected, p, q = surprise(c.lo.to_numpy(), c.hi.to_numpy(), c.n_ab.to_numpy(), c.w.to_numpy(), hist["item"].lo.to_numpy(), hist["item"].w.to_numpy(), hist["basket"].lo.to_numpy(), hist["basket"].w.to_numpy())
        return pd.DataFrame({"grp": c.grp, "lo": c.lo, "hi": c.hi, "n_ab": c.n_ab, "expected": expected, "p_value": p, "q_value": q})

    # Distinct degrees and counts, not pairs: few even for the largest group.
    scored = rows.groupBy("grp").applyInPandas(model, "grp string, lo long, hi long, n_ab long, expected double, p_value double, q_value double")
    total = baskets.groupBy("grp").agg(F.max("n").alias("n"))
    pairs = pairs.withColumn("lo", F.least("n_a", "n_b")).withColumn("hi", F.greatest("n_a", "n_b")).join(scored, ["grp", "lo", "hi", "n_ab"]).join(total, "grp")
    return pairs.select("grp", *[x.split()[0] for x in PAIR_SCHEMA.split(", ")])


def spelling(column) -> F.Column:
    """Key under which spellings of an entity id meet: case, -, _, blanks and a plural s don't matter."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"[\s _\-‐-―]+", ""), "s$", "")


def paper_baskets(mentions: DataFrame, entities: DataFrame, papers: DataFrame) -> DataFrame:
    """(grp, n, items): the entities of each on-topic paper of each run.

    Of the rows of (run_id, chunk_id, entity_id as written) the newest tagged_at
    counts (ties: the greater mention_count; a null time is oldest), if its count
    is at least 1. Of a paper the newest built_at counts; on_topic must be true.
    Spellings that match no entity, and null ids, are ignored. ``n`` also counts
    papers without a mention.
    """
    newest = mentions.groupBy("run_id", "chunk_id", "entity_id").agg(F.max(F.struct("tagged_at", "mention_count", "paper_id")).alias("m"))
    newest = newest.filter(F.col("m.mention_count") >= 1).select("run_id", F.col("m.paper_id").alias("paper_id"), spelling(F.col("entity_id")).alias("key"))
    names = entities.select(F.col("entity_id").alias("item"), "entity_type", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelt"))
    names = names.filter(F.col("spelt").isNotNull()).select(spelling(F.concat_ws(":", "entity_type", "spelt")).alias("key"), "item").groupBy("key").agg(F.min("item").alias("item"))
    topic = papers.groupBy("run_id", "paper_id").agg(F.max(F.struct("built_at", "on_topic")).alias("p")).filter(F.col("p.on_topic")).select("run_id", "paper_id")
    # The list of entities doesn't grow with the mentions; its size is still checked.
    small = within_bytes(entities, BROADCAST_BYTES)
    found = newest.join(F.broadcast(names) if small else names, "key").select("run_id", "paper_id", "item").join(topic, ["run_id", "paper_id"])
    n = topic.groupBy(F.col("run_id").alias("grp")).agg(F.count("*").alias("n"))
    baskets = found.groupBy(F.col("run_id").alias("grp"), "paper_id").agg(F.collect_set("item").alias("items")).select("grp", "items")
    return baskets.join(n, "grp").select("grp", "n", "items")


def _pairs(spark, sf_dir: str) -> DataFrame:
    mentions, entities, papers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("kg_mentions", "kg_entities", "kg_papers"))
    return pairs_in_groups(paper_baskets(mentions, entities, papers))


def p3_pairs(spark, sf_dir: str) -> DataFrame:
    """Every pair that occurs together, with its surprise."""
    pairs = _pairs(spark, sf_dir)
    return pairs.select(F.col("grp").alias("run_id"), F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"), "n_ab", "expected", "p_value", "q_value")


def p3_found(spark, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    enough = (F.col("n_ab") >= 3) & (F.col("n_ab") * F.col("n") >= 2 * F.col("n_a") * F.col("n_b"))
    return pairs.filter(enough).select(F.col("grp").alias("run_id"), F.col("item_a").alias("entity_a"), F.col("item_b").alias("entity_b"))


P3_BASE = r"""
WITH m AS (SELECT run_id, entity_id, max(struct_pack(t := tagged_at, c := mention_count, p := paper_id)) AS x
           FROM kg_mentions GROUP BY run_id, chunk_id, entity_id),
names AS (SELECT entity_id AS item, entity_type || ':' || name AS spelt FROM kg_entities
          UNION ALL SELECT entity_id, entity_type || ':' || unnest(aliases) FROM kg_entities),
keys AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(spelt), '[\s_-]+', '', 'g'), 's$', '') AS k, item FROM names),
topic AS (SELECT run_id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, paper_id ORDER BY built_at DESC, on_topic DESC NULLS LAST) AS rn FROM kg_papers)
          WHERE rn = 1 AND on_topic),
inc AS (SELECT DISTINCT m.run_id, m.x.p AS paper_id, k.item FROM m JOIN keys k
        ON k.k = regexp_replace(regexp_replace(lower(m.entity_id), '[\s_-]+', '', 'g'), 's$', '')
        JOIN topic t ON t.run_id = m.run_id AND t.paper_id = m.x.p WHERE m.x.c >= 1),
n AS (SELECT run_id, count(*) AS n FROM topic GROUP BY run_id),
f AS (SELECT run_id, item, count(*) AS f FROM inc GROUP BY run_id, item),
ab AS (SELECT a.run_id, a.item AS entity_a, b.item AS entity_b, count(*) AS n_ab FROM inc a JOIN inc b
       ON a.run_id = b.run_id AND a.paper_id = b.paper_id AND a.item < b.item GROUP BY ALL)
"""
P3_FOUND = P3_BASE + """
SELECT ab.run_id, entity_a, entity_b FROM ab JOIN n USING (run_id)
JOIN f fa ON fa.run_id = ab.run_id AND fa.item = entity_a JOIN f fb ON fb.run_id = ab.run_id AND fb.item = entity_b
WHERE n_ab >= 3 AND n_ab * n >= 2 * fa.f * fb.f
"""

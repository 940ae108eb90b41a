"""Subject areas of documents: complement naive Bayes refined by expectation-maximisation.

Words are hashed to a fixed number of buckets per language, so the model has a fixed size
whatever the corpus. A word's weight for a subject is the logarithm of its share
in all text over its smoothed share in text of every other subject (the
complement). A document is cut into segments; a segment's weights add up to its
evidence for each subject, against the evidence for none. Weights are trained on
the labelled documents and then on all documents with the segments' posteriors.
A part of the labelled documents is held out of this; on it, the odds that
annotators name a subject are fitted to its share of a document, subject by
subject. A document is about the subjects whose calibrated posterior is a half
or more.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import materialise, within_bytes

# Frequent words by which a text's language is told, and the buckets of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with are by from this we on between",
    "de": "der die das und ist nicht mit von für unter nach wie wir dass eine im den bei auf",
    "fr": "le la les des et est une dans pour que sur avec par du au aux ces cette",
    "es": "el la los las de y es una en para que con por del más se un al",
}
BLOCKS = {"en": 1 << 17, "de": 40_000, "fr": 40_000, "es": 40_000}
SIZES = np.array(list(BLOCKS.values()))
BASES = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
BUCKETS = int(SIZES.sum())
HASH_BITS = 20
#: Words of letters, and the ends of segments.
TOKEN = re.compile(r"[^\W\d_]{2,}|[.!?](?=\s)|\n[ \t\r]*\n")
LINE_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
CHARS_AT_ONCE = 1 << 20
MAX_CACHE = 1 << 20
SMOOTHING = 1.0
NONE_PRIOR = 0.3  # share of segments expected to be about no subject
FLOOR = 0.02  # least prior of a subject in a document, so that new evidence can enter
CLIP = 6.0
HELD_OUT = 5  # one labelled document in so many is kept for calibration
SHARE_FLOOR = 0.01
EVEN = 0.2  # the share that counts as half likely before any label is seen
MOST_SUBJECTS = 1000  # beyond it the model doesn't fit the workers


class Segmenter:
    """Texts to (bucket of each word, first word of each segment, segments per text)."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}
        self.function_words = [set(x.split()) for x in FUNCTION_WORDS.values()]

    def _new(self, word: str) -> int:
        k = -1
        if word[0].isalpha():
            bits = sum(1 << i for i, known in enumerate(self.function_words) if word in known)
            k = zlib.crc32(word.encode("utf-8")) & ((1 << HASH_BITS) - 1) | bits << HASH_BITS
        if len(self.cache) >= MAX_CACHE:
            self.cache.clear()
        self.cache[word] = k
        return k

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get, new = self.cache.get, self._new
        codes: list[int] = []
        ends = []
        for text in texts:
            if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
                text = unicodedata.normalize("NFKC", text)
            if "-" in text or "­" in text or "‐" in text:
                text = LINE_HYPHEN.sub("", text)
            codes.extend([k if (k := get(w)) is not None else new(w) for w in TOKEN.findall(text.lower())])
            codes.append(-2)
            ends.append(len(codes))
        c = np.array(codes, np.int64)
        doc = np.zeros(len(c), np.int64)
        doc[np.array(ends[:-1], np.int64)] = 1
        doc = np.cumsum(doc)
        word = c >= 0
        segment = np.cumsum(~word)
        fresh = np.ones(word.sum(), bool)
        fresh[1:] = np.diff(segment[word]) > 0
        starts = np.flatnonzero(fresh)
        c, of = c[word], doc[word]
        hits = np.stack([np.bincount(of[(c >> (HASH_BITS + i)) & 1 == 1], minlength=len(texts)) for i in range(len(BLOCKS))])
        language = hits.argmax(0)[of]
        return BASES[language] + (c & ((1 << HASH_BITS) - 1)) % SIZES[language], starts, of[starts]


def weights(counts: np.ndarray) -> np.ndarray:
    """[bucket, subject] from expected counts [subject + 1, bucket]; the last row is of no subject."""
    w = np.zeros((len(counts) - 1, BUCKETS))
    for a, n in zip(BASES, SIZES):  # each language against itself, as few texts are in some
        c = counts[:, a : a + n]
        total = c.sum(0)
        share = np.log((total + SMOOTHING) / (total.sum() + SMOOTHING * n))
        rest = total - c[:-1]
        other = np.log((rest + SMOOTHING) / (rest.sum(1, keepdims=True) + SMOOTHING * n))
        part = np.clip(share - other, -CLIP, CLIP)
        part[:, total < 2] = 0  # met once: no evidence
        w[:, a : a + n] = part
    return np.ascontiguousarray(w.T.astype(np.float32))


def posteriors(w: np.ndarray, buckets: np.ndarray, starts: np.ndarray, doc: np.ndarray, n: int, prior: np.ndarray | None, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(segment posteriors [segment, subject + none], evidence-bearing words per segment).

    ``prior``: [text, subject] of labelled texts; else each text's own shares are its prior, in ``rounds``.
    """
    k = w.shape[1]
    own = w[buckets]
    score = np.add.reduceat(own, starts, axis=0) if len(starts) else np.zeros((0, k), np.float32)
    telling = (own.max(1) > 1.0).astype(np.float32)
    mass = np.add.reduceat(telling, starts) if len(starts) else np.zeros(0, np.float32)
    base = np.full((n, k), 1.0 / k) if prior is None else prior
    for _ in range(1 if prior is not None else rounds):
        logits = np.concatenate([score + np.log(np.maximum(base[doc], FLOOR / k)) + np.log(1 - NONE_PRIOR), np.full((len(score), 1), np.log(NONE_PRIOR))], 1)
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        if prior is None:
            base = np.zeros((n, k))
            np.add.at(base, doc, p[:, :k] * mass[:, None])
            base = (base + 1.0 / k) / (base.sum(1, keepdims=True) + 1)
    return p, mass


FLAG, MASK = 1 << 30, (1 << 30) - 1  # the first word of a segment is flagged
WORDS_AT_ONCE = 200_000


def encode(documents: DataFrame) -> DataFrame:
    """(doc_id, language, codes): each text as its words' buckets, four bytes a word; texts without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            a, n = 0, 0
            for i, t in enumerate(texts):
                n += len(t)
                if n <= CHARS_AT_ONCE and i < len(texts) - 1:
                    continue
                buckets, starts, doc = cut(texts[a : i + 1])
                codes = buckets.astype(np.int32)
                codes[starts] |= FLAG
                words = np.bincount(np.repeat(doc, np.diff(np.append(starts, len(buckets)))), minlength=i + 1 - a)
                ends = np.cumsum(words)
                data = codes.tobytes()
                some = np.flatnonzero(words)
                language = np.searchsorted(BASES, buckets[(ends - words)[some]], side="right") - 1
                values = [data[4 * (e - w) : 4 * e] for e, w in zip(ends[some].tolist(), words[some].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + a)), pa.array(language.astype(np.int32)), pa.array(values, pa.binary())], names=["doc_id", "language", "codes"])
                a, n = i + 1, 0

    rows = documents.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, language int, codes binary")


def _decoded(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets, first word and text of each segment) of slices of a batch."""
    values = batch.column(column).to_pylist()
    a, n = 0, 0
    for i, v in enumerate(values):
        n += len(v) // 4
        if n <= WORDS_AT_ONCE and i < len(values) - 1:
            continue
        codes = np.frombuffer(b"".join(values[a : i + 1]), np.int32)
        starts = np.flatnonzero(codes & FLAG)
        ends = np.cumsum([len(x) // 4 for x in values[a : i + 1]])
        yield a, i + 1, codes & MASK, starts, np.searchsorted(ends, starts, side="right")
        a, n = i + 1, 0


def _counts(rows: DataFrame, k: int, model: np.ndarray | None, labelled: bool) -> np.ndarray:
    """Expected counts [subject + 1, bucket] over ``rows`` (codes[, votes]); at most BUCKETS rows reach the driver."""
    names = [f"c{i}" for i in range(k + 1)]
    share = rows.sparkSession.sparkContext.broadcast(model)  # BUCKETS x subjects floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = share.value
        out = np.zeros((BUCKETS, k + 1), np.float32)
        for batch in batches:
            for a, b, buckets, starts, doc in _decoded(batch, 0):
                prior = None
                if labelled:
                    votes = np.array(batch.column(1).slice(a, b - a).to_pylist(), float)
                    prior = 0.9 * votes / votes.sum(1, keepdims=True) + 0.1 / k
                if w is None:
                    p = np.concatenate([prior[doc] * (1 - NONE_PRIOR), np.full((len(doc), 1), NONE_PRIOR)], 1)
                else:
                    p, _ = posteriors(w, buckets, starts, doc, b - a, prior)
                # Only the few subjects that a segment may be about are added, bucket by bucket.
                n = np.diff(np.append(starts, len(buckets)))
                segment = np.repeat(np.arange(len(starts)), n)
                for s in range(k + 1):
                    about = p[:, s] > 1e-3
                    words = about[segment]
                    np.add.at(out[:, s], buckets[words], p[segment[words], s].astype(np.float32))
        at = np.flatnonzero(out.sum(1) > 0)
        for s in range(0, len(at), 50_000):
            part = at[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(out[part, c]) for c in range(k + 1)]], names=["bucket", *names])

    schema = "bucket int, " + ", ".join(f"{c} float" for c in names)
    table = rows.mapInArrow(run, schema).groupBy("bucket").agg(*[F.sum(c).cast("float").alias(c) for c in names]).toArrow()
    out = np.zeros((k + 1, BUCKETS))
    at = table.column("bucket").to_numpy()
    for i, c in enumerate(names):
        out[i, at] = table.column(c).to_numpy()
    share.destroy()
    return out


def label_votes(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, votes): per document the number of annotators for each subject; spelling doesn't matter."""
    spelt = F.regexp_replace(F.lower(F.trim("subject")), r"[\s_\-]+", "_")
    rows = labels.select("doc_id", spelt.alias("subject"), "annotator").filter(F.col("doc_id").isNotNull() & F.col("subject").isin(subjects)).distinct()
    return rows.groupBy("doc_id").agg(F.array(*[F.sum(F.when(F.col("subject") == s, 1.0).otherwise(0.0)) for s in subjects]).alias("votes"))


def held_out(column: str = "doc_id") -> F.Column:
    """Whether a labelled document is kept for calibration."""
    return F.pmod(F.xxhash64(column, F.lit("held out")), F.lit(HELD_OUT)) == 0


def _some_votes(labels: DataFrame, subjects: list[str], for_calibration: bool, most: int) -> DataFrame:
    """The votes of at most ``most`` documents, the first by a hash, so that every run takes the same."""
    part = held_out() if for_calibration else ~held_out()
    return label_votes(labels, subjects).filter(part).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(encoded: DataFrame, labels: DataFrame, subjects: list[str], labelled_rounds: int = 3, rounds: int = 2, other_rounds: int = 4, max_labelled: int = 50_000) -> np.ndarray:
    """Word weights from encoded documents, which should be a written table.

    Fitted on at most ``max_labelled`` labelled documents that aren't held out, then ``rounds`` times on all
    documents and ``other_rounds`` times more on those not in the first language.
    """
    k = len(subjects)
    votes = _some_votes(labels, subjects, False, max_labelled)
    small = within_bytes(labels, 8 << 20)
    known = encoded.join(F.broadcast(votes) if small else votes, "doc_id").select("codes", "votes").persist()
    counts = _counts(known, k, None, True)
    for _ in range(labelled_rounds):
        counts = _counts(known, k, weights(counts), True)
    known.unpersist()
    seeds = counts
    for _ in range(rounds):
        counts = _counts(encoded.select("codes"), k, weights(counts), False) + seeds
    rest = int(BASES[1])
    others = encoded.filter("language > 0").select("codes")
    for _ in range(other_rounds):  # the languages of few labels take longer; their blocks are their own
        counts[:, rest:] = (_counts(others, k, weights(counts), False) + seeds)[:, rest:]
    return weights(counts)


def subject_shares(encoded: DataFrame, model: np.ndarray, subjects: list[str], least: float = 0.0) -> DataFrame:
    """(doc_id, subject, share, words): shares of what a document says about any subject.

    A row for each subject of a share of at least ``least`` and above 0. ``words``
    counts the evidence-bearing words. A null, empty or subjectless text has no
    row; equal rows stay separate rows.
    """
    k = len(subjects)
    share = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = share.value
        for batch in batches:
            for a, b, buckets, starts, doc in _decoded(batch, 1):
                p, mass = posteriors(w, buckets, starts, doc, b - a, None)
                said = np.zeros((b - a, k))
                np.add.at(said, doc, p[:, :k] * mass[:, None])
                total = said.sum(1)
                frac = said / np.maximum(total, 1e-9)[:, None]
                d, s = np.nonzero((frac >= max(least, 1e-6)) & (total >= 1)[:, None])
                ids = batch.column(0).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(np.array(subjects, object)[s], pa.string()), pa.array(frac[d, s]), pa.array(total[d])], names=["doc_id", "subject", "share", "words"])

    return encoded.select("doc_id", "codes").mapInArrow(run, "doc_id long, subject string, share double, words double")


def _logit(share):
    """Log odds of a share; shares of 0 and 1 stay finite."""
    return np.log((share + SHARE_FLOOR) / (1 - share + SHARE_FLOOR))


def _curve(x: np.ndarray, y: np.ndarray, near: np.ndarray, ridge: float) -> np.ndarray:
    """Slope and offset of a logistic curve that is drawn to ``near`` with the weight ``ridge``."""
    x, beta = np.stack([x, np.ones(len(x))], 1), near.copy()
    for _ in range(60):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        beta = beta + np.linalg.solve(h, x.T @ (y - p) - ridge * (beta - near))
    return beta


def _without_noise(x: np.ndarray, y: np.ndarray, near: np.ndarray, ridge: float, noise: tuple[float, float] | None = None, rounds: int = 30) -> tuple[np.ndarray, float, float]:
    """(curve, share of wrong labels, share of missing labels): the curve of what labels without mistakes would be.

    Labels are wrong or left out at one rate each, which are fitted, or given as ``noise``, with the curve by
    expectation-maximisation; else a few wrong labels at the shares' ends would flatten it.
    """
    curve, (wrong, missing) = near, noise or (0.01, 0.05)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x * curve[0] + curve[1], -30, 30)))
        true = p * np.where(y > 0, 1 - missing, missing)
        q = true / (true + (1 - p) * np.where(y > 0, wrong, 1 - wrong))  # that the subject is there
        curve = _curve(x, q, near, ridge)
        if noise is None:
            wrong, missing = ((y * (1 - q)).sum() + 0.5) / ((1 - q).sum() + 50), (((1 - y) * q).sum() + 0.5) / (q.sum() + 10)
    return curve, float(wrong), float(missing)


def calibrate(shares: DataFrame, labels: DataFrame, subjects: list[str], max_labelled: int = 50_000) -> dict[str, tuple[float, float]]:
    """Slope and offset of a logistic curve per subject, from the log odds of its share to those that annotators name it.

    Fitted on at most ``max_labelled`` held-out documents, each subject on its own, drawn to the curve of all
    subjects together where a subject has few labels. Wrong and missing labels are taken out of the odds. Without
    any label, the even odds are at a share of EVEN.
    """
    votes = _some_votes(labels, subjects, True, max_labelled)
    each = votes.select("doc_id", F.posexplode("votes").alias("s", "v")).select("doc_id", F.element_at(F.array(*map(F.lit, subjects)), F.col("s") + 1).alias("subject"), (F.col("v") > 0).cast("double").alias("y"))
    rows = each.join(shares.select("doc_id", "subject", "share"), ["doc_id", "subject"], "left").select("subject", F.coalesce("share", F.lit(0.0)).alias("x"), "y").toPandas()
    x, y = _logit(rows.x.to_numpy(float)), rows.y.to_numpy(float)
    start = np.array([2.0, -2.0 * float(_logit(EVEN))])
    pooled, wrong, missing = _without_noise(x, y, start, 1.0)
    return {s: tuple(map(float, _without_noise(x[rows.subject == s], y[rows.subject == s], pooled, 5.0, (wrong, missing))[0])) for s in subjects}


def with_posterior(shares: DataFrame, curves: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``posterior``: the calibrated probability, subject by subject."""
    slope = F.create_map(*[F.lit(x) for s, (a, _) in curves.items() for x in (s, a)])[F.col("subject")]
    offset = F.create_map(*[F.lit(x) for s, (_, b) in curves.items() for x in (s, b)])[F.col("subject")]
    odds = F.log((F.col("share") + SHARE_FLOOR) / (1 - F.col("share") + SHARE_FLOOR))
    return shares.withColumn("posterior", 1 / (1 + F.exp(-(slope * odds + offset))))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, share, words, posterior) of every subject of which a document says anything, by the whole method.

    ``documents``: (doc_id, text); null and empty texts have no row. Repeated
    rows give repeated rows.
    """
    encoded = materialise(encode(documents), "codes")
    shares = materialise(subject_shares(encoded, train(encoded, labels, subjects), subjects), "shares")
    return with_posterior(shares, calibrate(shares, labels, subjects))


def _subjects(spark, sf_dir: str) -> DataFrame:
    documents, labels, subjects = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "subject_labels", "subjects"))
    names = sorted(r[0] for r in subjects.select("subject").filter("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return document_subjects(documents.select("doc_id", "text"), labels, names)


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).filter("posterior >= 0.5").select("doc_id", "subject").distinct()


def p8_posteriors(spark, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir)

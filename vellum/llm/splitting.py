"""Cutting oversized texts into pieces at natural boundaries.

A text or file is scanned in ranges, side by side. The worker of a range sees a
halo around it, which it widens until the words that begin in the range, and the
boundaries before and behind them, are whole; it writes a boundary table of these
words and, of each kind of boundary, the first and last place and the longest
unit between. The tables are stitched by prefix sums of their lengths: these
place every range in the cleaned text, and tell whether the text is oversized and
how weak a boundary must be used. The pieces are planned on the stitched tables
in one stream of numbers and emitted by offset. Where ranges are cut doesn't
change a piece.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.session import materialise, within_bytes

CHARS_PER_TOKEN = 4
RANGE_CHARS = 1 << 13
HALO = 256
# The defaults of a chunk configuration, in tokens (words for the last).
DEFAULTS = {"target_chunk_size": 500, "max_chunk_size": 600, "overlap_size": 75, "min_chunk_words": 60}
LEVELS = ["none", "word", "sentence", "paragraph"]
# Flags of a code point.
WHITE, BREAK, STOP, OPENING, LOWER, SOLID, HYPHEN = 1, 2, 4, 8, 16, 32, 64
# Unicode White_Space, and the characters that end a line.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LINE_ENDS = [0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]


@lru_cache(1)
def flag_table() -> np.ndarray:
    """Flags of every code point. Openings are capitals, quotes and opening brackets."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind in ("Lu", "Lt", "Pi", "Pf", "Ps"):
            t[cp] |= OPENING
        if kind == "Ll":
            t[cp] |= LOWER
        if kind[0] in "LNM":
            t[cp] |= SOLID
    t[WHITE_SPACE] |= WHITE
    t[LINE_ENDS] |= BREAK
    t[[ord(c) for c in ".!?"]] |= STOP
    t[[ord(c) for c in "\"'`"]] |= OPENING
    t[[0x2D, 0x2010, 0xAD]] |= HYPHEN
    return t


@dataclass
class Boundaries:
    """Words of a range: start, end (code points), the flags of first and last character, whether
    the last but one is solid, and the line breaks before each word; ``tail``: breaks after the last."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    solid: np.ndarray
    breaks: np.ndarray
    tail: int
    size: int


def scan(cps: np.ndarray, at: int = 0) -> Boundaries:
    """Words and line breaks of characters that begin at offset ``at``."""
    flags = flag_table()[cps]
    n = len(cps)
    white = (flags & WHITE) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    brk = (flags & BREAK) > 0
    brk[1:] &= ~((cps[1:] == 0x0A) & (cps[:-1] == 0x0D))  # a pair of carriage return and line feed is one break
    upto = np.concatenate([[0], np.cumsum(brk)])
    previous = np.concatenate([[0], end[:-1]]) if len(start) else start
    breaks = upto[start] - upto[previous]
    tail = int(upto[n] - (upto[end[-1]] if len(end) else 0))
    solid = (flags[np.maximum(end - 2, 0)] & SOLID > 0) & (end - start > 1)
    return Boundaries(start + at, end + at, flags[start], flags[np.maximum(end - 1, 0)], solid, breaks, tail, n)


@dataclass
class Words:
    """Words (parts, where hyphens join lines) with their place in the cleaned text; ``level`` is that
    of the boundary before each: 3 paragraph, 2 sentence, 1 word, 0 within a word."""

    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    to: np.ndarray
    level: np.ndarray


def clean_layout(b: Boundaries) -> Words:
    """In the cleaned text a blank run is one character, a paragraph break two, a hyphen at a line end none."""
    n = len(b.start)
    level = np.ones(n, np.int8)
    length = b.end - b.start
    if n:
        sentence = ((b.last[:-1] & STOP) > 0) & ((b.first[1:] & OPENING) > 0)
        level[1:][sentence] = 2
        level[1:][b.breaks[1:] >= 2] = 3
        hyphen = ((b.last[:-1] & HYPHEN) > 0) & b.solid[:-1] & (b.breaks[1:] == 1) & ((b.first[1:] & LOWER) > 0)
        level[1:][hyphen] = 0
        length = length.copy()
        length[:-1][hyphen] -= 1
        level[0] = 3
    gap = np.where(level == 3, 2, (level > 0).astype(np.int64))
    if n:
        gap[0] = 0
    to = np.cumsum(length + gap)
    return Words(b.start, b.end, to - length, to, level)


def longest(w: Words, level: int) -> int:
    """Length of the longest unit between boundaries of at least ``level``."""
    if not len(w.at):
        return 0
    first = np.flatnonzero(w.level >= level)
    last = np.append(first[1:] - 1, len(w.at) - 1)
    return int((w.to[last] - w.at[first]).max())


def weakest(w: Words, limit: int) -> int:
    """The level of the weakest boundary that must be used to keep under the limit."""
    return next((k for k in (3, 2, 1) if longest(w, k) <= limit), 0)


def _parted(w: Words, limit: int, overlap: int, width: np.ndarray | None = None) -> Words:
    """Words longer than the limit in parts of a quarter of it at most, so that pieces fit and overlap by whole parts.

    ``width``: position of every character where these aren't one apart; ``start`` and ``end`` are then indices into it.
    """
    size = w.to - w.at
    part = max(1, min(overlap or limit, limit // 4))
    times = np.where(size > limit, -(-size // part), 1).astype(np.int64)
    if (times == 1).all():
        return w
    k = np.repeat(np.arange(len(size)), times)
    j = np.arange(len(k)) - np.repeat(np.cumsum(times) - times, times)
    start = w.start[k] + j * part
    rest = j == times[k] - 1
    end, to = np.where(rest, w.end[k], start + part), np.where(rest, w.to[k], w.at[k] + (j + 1) * part)
    return Words(start, end, w.at[k] + j * part, to, np.where(j == 0, w.level[k], 0).astype(np.int8))


class Planner:
    """Plans pieces on a stream of words, with a window of a few times the limit in memory.

    Pieces, overlap included, never exceed ``limit``. A cut is made at the strongest level that has a
    boundary within the limit, at the one that brings the piece nearest to ``target``, and leaves no last
    piece of fewer than ``min_words`` words. The overlap is the longest run of whole words (of parts, in
    a word beyond the limit) of at most ``overlap`` characters before the cut; more than half the limit
    is taken as half of it, as each piece must bring something new. ``needed`` and ``words``, the number
    of words, are those of the whole text.
    """

    def __init__(self, target: int, limit: int, overlap: int, min_words: int, needed: int, words: int):
        self.target, self.limit, self.overlap, self.min_words = target, limit, min(overlap, limit // 2), min_words
        self.needed, self.words = needed, words
        none = np.empty(0, np.int64)
        self.held = Words(none, none, none, none, np.empty(0, np.int8))
        self.before, self.begin, self.fresh, self.done = 0, 0, 0, False

    def feed(self, w: Words, final: bool = False) -> list[tuple[int, int, int, int]]:
        """Adds words; (start, end, level of the cut at the end, cleaned length) of the pieces that are sure by now."""
        h, b = self.held, self.begin
        self.before += int((h.level[:b] > 0).sum())
        h = Words(*(np.append(getattr(h, f)[b:], getattr(w, f)) for f in ("start", "end", "at", "to", "level")))
        self.held, self.begin, self.fresh = h, 0, self.fresh - b
        n = len(h.at)
        # Behind a cut, which lies within the limit, the next unit must be known, which is within it again.
        if not n or self.done or (not final and h.to[-1] - h.at[0] < 2 * self.limit + 8):
            return []
        count = np.cumsum(h.level > 0) + self.before
        places = [np.flatnonzero(h.level >= k) for k in range(4)]
        tail = int(np.searchsorted(count, self.words - self.min_words, side="right"))
        out, begin, fresh = [], 0, self.fresh
        while True:
            base = int(h.at[begin])
            if final and h.to[-1] - base <= self.limit:
                out.append((int(h.start[begin]), int(h.end[-1]), 3, int(h.to[-1] - base)))
                self.done = True
                break
            if not final and h.to[-1] - base < 2 * self.limit + 8:
                break
            last = int(np.searchsorted(h.to, base + self.limit, side="right"))  # a cut before word ``last`` fits
            cut = self._cut(h, count, places, begin, fresh, base, last, tail)
            out.append((int(h.start[begin]), int(h.end[cut - 1]), int(h.level[cut]), int(h.to[cut - 1] - base)))
            before, fresh, begin = begin, cut, cut
            if self.overlap:
                back = int(np.searchsorted(h.at, h.to[cut - 1] - self.overlap, side="left"))
                while back < cut and h.level[back] == 0 and h.level[cut] > 0:
                    back += 1  # not within a word
                begin = min(max(back, before + 1), cut)  # never the whole piece again
                # The next unit must still fit behind the overlap at the level that is needed.
                p = places[self.needed]
                k = np.searchsorted(p, cut, side="right")
                nxt = int(p[k]) if k < len(p) else n
                while begin < cut and h.to[nxt - 1] - h.at[begin] > self.limit:
                    begin += 1
        self.begin, self.fresh = begin, fresh
        return out

    def _cut(self, h: Words, count: np.ndarray, places: list[np.ndarray], begin: int, fresh: int, base: int, last: int, tail: int) -> int:
        """The word before which the piece that begins with ``begin`` ends."""
        some = min(last, tail)
        for most, least, weakest_cut in ((some, self.min_words, self.needed), (some, 0, self.needed), (last, 0, self.needed), (last, 0, 0)):
            for level in range(3, weakest_cut - 1, -1):
                p = places[level]
                c = p[np.searchsorted(p, fresh, side="right") : np.searchsorted(p, most, side="right")]
                c = c[count[c - 1] - (count[begin] - 1) >= least] if level < 3 and least and len(c) else c
                if len(c):
                    return int(c[np.argmin(np.abs(h.to[c - 1] - base - self.target))])
        return max(last, fresh + 1)


def plan(w: Words, target: int, limit: int, overlap: int, min_words: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(weakest level that must be used, pieces) of the words of a whole text, by Planner."""
    needed = weakest(w, limit)
    w = _parted(w, limit, min(overlap, limit // 2))
    return needed, Planner(target, limit, overlap, min_words, needed, int((w.level > 0).sum())).feed(w, True)


@dataclass
class Around:
    """Characters around a range: their code points and positions (one more, for the end)."""

    cps: np.ndarray
    at: np.ndarray


def characters(text: str) -> Callable[[int, int], Around]:
    """Reader of a text by character."""
    cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return lambda lo, hi: Around(cps[lo:hi], np.arange(lo, min(hi, len(cps)) + 1))


def file_bytes(f, size: int) -> Callable[[int, int], Around]:
    """Reader of a UTF-8 file by byte; a byte that is no part of a character is a character of its own."""

    def read(lo: int, hi: int) -> Around:
        lo, hi = max(0, lo), min(hi, size)
        f.seek(lo)
        data = f.read(hi - lo)
        skip = next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0) if lo else 0
        tail = next((i for i in range(1, min(4, len(data)) + 1) if data[-i] & 0xC0 != 0x80), 0) if hi < size else 0
        keep = len(data) - tail if tail and data[-tail] >= 0xC0 else len(data)  # a character that isn't whole
        cps = np.frombuffer(data[skip:keep].decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        lone = (cps >= 0xDC80) & (cps <= 0xDCFF)
        width = 1 + (cps > 0x7F) + (cps > 0x7FF).astype(np.int64) + (cps > 0xFFFF)
        return Around(np.where(lone, 0xFFFD, cps).astype(np.uint32), lo + skip + np.concatenate([[0], np.cumsum(np.where(lone, 1, width))]))

    return read


def range_words(read: Callable[[int, int], Around], a: int, b: int, size: int, limit: int, overlap: int, halo: int = HALO) -> Words:
    """The words that begin in [a, b) of a text or file of ``size``: ``at`` and ``to`` count from the end of the word before.

    The halo is widened until the first word's predecessor and the last word's successor are in it.
    """
    left = right = max(halo, 8)
    while True:
        lo, hi = max(0, a - left), min(size, b + right)
        win = read(lo, hi)
        t = scan(win.cps)
        start = win.at[t.start]
        # A word at the window's begin may have begun before it.
        mine = np.flatnonzero((start >= a) & (start < b) & ((t.start > 0) | (lo == 0)))
        if not len(mine):
            none = np.empty(0, np.int64)
            return Words(none, none, none, none, np.empty(0, np.int8))
        i, j = int(mine[0]), int(mine[-1])
        known_left = lo == 0 or (i > 0 and t.end[i - 1] >= 2)
        known_right = hi == size or j + 1 < len(t.start)
        if known_left and known_right:
            break
        left, right = left * (1 if known_left else 4), right * (1 if known_right else 4)
    w = clean_layout(t)
    before = int(w.to[i - 1]) if i else 0
    own = Words(t.start[i : j + 1], t.end[i : j + 1], w.at[i : j + 1] - before, w.to[i : j + 1] - before, w.level[i : j + 1])
    own = _parted(own, limit, min(overlap, limit // 2))
    return Words(win.at[own.start], win.at[own.end], own.at, own.to, own.level)


def pack(w: Words) -> bytes:
    """The words of a range in few bytes: numbers of one byte where they fit."""
    parts = [np.int64(w.start[0] if len(w.start) else 0).tobytes()]
    for v in (w.start - np.append(w.start[:1], w.end[:-1]), w.end - w.start, w.at - np.append(0, w.to[:-1]) if len(w.at) else w.at, w.to - w.at):
        kind = np.uint8 if v.max(initial=0) < 256 else np.int64
        parts += [bytes([kind is np.int64]), v.astype(kind).tobytes()]
    return b"".join([*parts, w.level.tobytes()])


def unpack_words(data: bytes, n: int, base: int) -> Words:
    """The words of a range whose predecessor ends at ``base`` of the cleaned text."""
    first, at, cols = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for _ in range(4):
        kind = np.int64 if data[at] else np.uint8
        cols.append(np.frombuffer(data, kind, n, at + 1).astype(np.int64))
        at += 1 + n * np.dtype(kind).itemsize
    skip, raw, gap, clean = cols
    end = first + np.cumsum(skip + raw)
    to = base + np.cumsum(gap + clean)
    return Words(end - raw, end, to - clean, to, np.frombuffer(data, np.int8, n, at))


SIZES = ["target", "size_limit", "overlap", "min_words"]
SUMMARY = [f"{f}{k}" for k in (1, 2, 3) for f in ("head", "last", "unit")]
TABLE_SCHEMA = "doc string, h long, k long, " + ", ".join(f"{c} int" for c in SIZES) + ", n int, words long, total long, " + ", ".join(f"{c} long" for c in SUMMARY) + ", data binary"
TABLE_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int32(), pa.int64(), pa.int64(), *[pa.int64()] * 9, pa.binary()]


def summary(w: Words) -> list[int | None]:
    """Of each level from 1 on: where the unit that enters the range ends, where the last begins, the longest between."""
    out: list[int | None] = []
    for k in (1, 2, 3):
        first = np.flatnonzero(w.level >= k)
        if len(first):
            inner = w.to[first[1:] - 1] - w.at[first[:-1]]
            out += [int(w.to[first[0] - 1]) if first[0] else 0, int(w.at[first[-1]]), int(inner.max(initial=0))]
        else:
            out += [None, None, None]
    return out


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TABLE_TYPES)], names=[c.split()[0] for c in TABLE_SCHEMA.split(", ")])


def _table_row(doc: str, h: int, k: int, sizes: list[int], w: Words) -> tuple:
    return (doc, h, k, *sizes, len(w.at), int((w.level > 0).sum()), int(w.to[-1]) if len(w.to) else 0, *summary(w), pack(w))


def stitched(tables: DataFrame) -> DataFrame:
    """(doc, h, needed, words, total) of each text from the summaries of its ranges, by prefix sums of their lengths."""
    order = Window.partitionBy("doc", "h").orderBy("k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = tables.select("doc", "h", "k", "size_limit", "words", "total", *SUMMARY).dropDuplicates(["doc", "h", "k"])
    t = t.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    for k in (1, 2, 3):  # the last boundary in front of a range is the furthest so far
        t = t.withColumn(f"from{k}", F.max(F.col("base") + F.col(f"last{k}")).over(before))
    ends = [F.greatest(F.max(f"unit{k}"), F.max(F.col("base") + F.col(f"head{k}") - F.col(f"from{k}")), F.sum("total") - F.max(F.col("base") + F.col(f"last{k}"))).alias(f"longest{k}") for k in (1, 2, 3)]
    one = t.groupBy("doc", "h").agg(F.max("size_limit").alias("size_limit"), F.sum("words").alias("words"), F.sum("total").alias("total"), *ends)
    needed = F.lit(0)
    for k in (1, 2, 3):
        needed = F.when(F.col(f"longest{k}") <= F.col("size_limit"), k).otherwise(needed)
    return one.select("doc", "h", needed.alias("needed"), "words", "total", "size_limit")


PIECES_SCHEMA = "doc string, h long, needed int, piece int, start long, end long, cut int, length int"


def planned(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc, h, needed, piece, start, end, cut, length) of the ``chosen`` texts (doc, h, needed, words) from their boundary tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        planner, doc, k_last, base, number = None, None, -1, 0, 0

        def keep(pieces: list[tuple]) -> None:
            nonlocal number
            for a, b, cut, length in pieces:
                held.append((*doc, planner.needed, number, a, b, cut, length))
                number += 1

        def out() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=[c.split()[0] for c in PIECES_SCHEMA.split(", ")])
            held.clear()
            return batch

        none = unpack_words(bytes(12), 0, 0)
        for batch in batches:
            for d, h, k, target, limit, overlap, least, n, data, needed, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, h) != doc:
                    if planner:
                        keep(planner.feed(none, True))
                    planner, doc, k_last, base, number = Planner(target, limit, overlap, least, needed, words), (d, h), -1, 0, 0
                if k == k_last:  # a repeated row
                    continue
                w = unpack_words(data, n, base)
                k_last, base = k, int(w.to[-1]) if n else base
                keep(planner.feed(w))
                if len(held) >= 20_000:
                    yield out()
        if planner:
            keep(planner.feed(none, True))
        if held:
            yield out()

    rows = tables.select("doc", "h", "k", *SIZES, "n", "data").join(chosen.select("doc", "h", "needed", "words"), ["doc", "h"])
    rows = rows.select("doc", "h", "k", *SIZES, "n", "data", "needed", "words").repartition("doc").sortWithinPartitions("doc", "h", "k")
    return rows.mapInArrow(run, PIECES_SCHEMA)


def _sizes(configs: DataFrame) -> DataFrame:
    tokens = {c: F.coalesce(F.col(c).cast("int"), F.lit(d)) for c, d in DEFAULTS.items()}
    return configs.select(
        F.col("config_id").alias("__config__"),
        *[(v * (1 if c == "min_chunk_words" else CHARS_PER_TOKEN)).alias(c) for c, v in tokens.items()],
    ).dropDuplicates(["__config__"])


def _named(column: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.col(column) + 1)


def split_texts(sections: DataFrame, configs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """(section_id, h, boundary, piece, start, end, cut, length): a row for each piece of each oversized section, by offset.

    Oversized is a text whose cleaned form (blank runs as one blank, paragraphs
    parted by two line breaks) has more characters than four times its
    configuration's max_chunk_size. A null config_id means "default"; a null
    number, and an unknown configuration, take the defaults. ``boundary`` is the
    weakest that must be used; ``start`` and ``end`` are offsets in the text as
    given, ``cut`` the kind of boundary behind the piece, ``length`` its cleaned
    length, ``h`` a number of the text. Null, blank and short texts, and null
    ids, give no row; of rows with one section_id the longest text counts. Only
    boundary tables are shuffled; ``range_chars`` changes no row.
    """
    sizes = _sizes(configs)
    keyed = sections.filter(F.col("section_id").isNotNull()).select("section_id", F.coalesce("config_id", F.lit("default")).alias("__config__"), F.col("text").cast("string").alias("text"))
    keyed = keyed.filter(F.length("text") > CHARS_PER_TOKEN)  # before the join: never oversized
    joined = keyed.join(F.broadcast(sizes) if within_bytes(configs, 8 << 20) else sizes, "__config__", "left")
    full = joined.select("section_id", "text", *[F.coalesce(c, F.lit(d * (1 if c == "min_chunk_words" else CHARS_PER_TOKEN))).alias(c) for c, d in DEFAULTS.items()])
    large = full.filter(F.length("text") > F.col("max_chunk_size"))  # cleaning makes no text longer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 64):
                rows = []
                for sid, text, target, limit, overlap, least in zip(*(c.to_pylist() for c in whole.slice(s, 64).columns)):
                    limit = max(1, limit)
                    sizes = [max(1, min(target, limit)), limit, max(0, overlap), max(0, least)]
                    read, size, h = characters(text), len(text), hash_of(text)
                    rows += [_table_row(sid, h, k, sizes, range_words(read, a, a + range_chars, size, limit, sizes[2])) for k, a in enumerate(range(0, size, range_chars))]
                yield _table_batch(rows)

    tables = materialise(large.mapInArrow(run, TABLE_SCHEMA), "boundaries")
    order = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("h")))
    chosen = stitched(tables).withColumn("r", order).filter("r = 1 and total > size_limit")
    p = planned(tables, chosen)
    return p.select(F.col("doc").alias("section_id"), "h", _named("needed").alias("boundary"), "piece", "start", "end", _named("cut").alias("cut"), "length")


def hash_of(text: str) -> int:
    """A fixed number of a text, the same on every worker: its bytes and their checksum, as ``pieces`` computes it in the JVM."""
    data = text.encode("utf-8", "replace")
    return (len(data) << 32) | zlib.crc32(data)


def pieces(sections: DataFrame, configs: DataFrame) -> DataFrame:
    """(section_id, piece, text, cut): the cleaned text of each piece of split_texts, cut from the text that was planned."""
    plans = split_texts(sections, configs)
    each = plans.groupBy("section_id", "h").agg(F.sort_array(F.collect_list(F.struct("piece", "start", "end", "cut"))).alias("p"))  # of one text, which a row holds anyway
    ids = plans.select("section_id").distinct()
    texts = sections.filter(F.length("text") > CHARS_PER_TOKEN).select("section_id", F.col("text").cast("string").alias("text")).join(ids, "section_id", "left_semi")
    texts = texts.withColumn("h", F.shiftleft(F.octet_length("text").cast("long"), 32).bitwiseOR(F.crc32("text"))).dropDuplicates(["section_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                rows = [(sid, x["piece"], text[x["start"] : x["end"]], x["cut"]) for sid, text, p in zip(*(c.to_pylist() for c in batch.slice(s, 64).columns)) for x in p]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int32(), pa.string(), pa.string()])], names=["section_id", "piece", "text", "cut"])

    cut = texts.join(each, ["section_id", "h"]).select("section_id", "text", "p").mapInArrow(run, "section_id string, piece int, text string, cut string")
    return cut.select("section_id", "piece", clean_text(F.col("text")).alias("text"), "cut")


def clean_text(column) -> F.Column:
    """Paragraphs parted by one empty line, blank runs as one space, lines joined at hyphens."""
    brk = r"(?:\r\n|[\n\x0B\f\r\x85  ])"
    blank = r"[ \t\xA0 - 　]*"
    joined = F.regexp_replace(column, rf"([\p{{L}}\p{{N}}\p{{M}}])[-‐\xAD]{blank}{brk}{blank}(?=\p{{Ll}})", "$1")
    paragraphs = F.regexp_replace(joined, rf"{blank}{brk}{blank}(?:{brk}{blank})+", "\u0000")
    return F.regexp_replace(F.trim(F.regexp_replace(paragraphs, r"(?U)\s+", " ")), r" ?\x00 ?", "\n\n")


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inner


def split_files(spark: SparkSession, paths: list[str], target: int = 2000, limit: int = 2400, overlap: int = 300, min_words: int = 60, range_bytes: int = 8 << 20, halo: int = HALO) -> DataFrame:
    """(path, piece, byte_start, byte_end, cut, text): UTF-8 files of any size, cut by byte range.

    A worker reads one range and a halo around it, never a whole file; the plan
    is a stream over the boundary tables, and each piece is read again by its
    offset, so pieces and overlaps cross ranges and ``range_bytes`` changes no
    row. A word or blank run longer than the halo is read on by the one range it
    begins in. An empty or blank file gives no row; a small one is one piece;
    bytes that aren't UTF-8 are characters of their own.
    """
    ranges = []
    for path in dict.fromkeys(paths):
        system, inner = _open(path)
        size = system.get_file_info(inner).size
        ranges += [(path, k, a, size) for k, a in enumerate(range(0, size, range_bytes))]
    columns = "path string, piece int, byte_start long, byte_end long, cut string, text string"
    if not ranges:
        return spark.createDataFrame([], columns)
    work = spark.createDataFrame(ranges, "path string, k long, at long, size long").repartition(min(len(ranges), 10_000), "path", "k")
    sizes = [max(1, min(target, limit)), max(1, limit), max(0, overlap), max(0, min_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, inner = _open(path)
                with system.open_input_file(inner) as f:
                    yield _table_batch([_table_row(path, 0, k, sizes, range_words(file_bytes(f, size), at, min(at + range_bytes, size), size, sizes[1], sizes[2], halo))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, start, end = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for path in dict.fromkeys(paths):
                mine = [i for i, p in enumerate(paths) if p == path]
                system, inner = _open(path)
                with system.open_input_file(inner) as f:
                    text = []
                    for i in mine:
                        f.seek(start[i])
                        text.append(f.read(end[i] - start[i]).decode("utf-8", "replace"))
                rows = batch.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.string())], names=[c.split()[0] for c in columns.split(", ")])

    tables = materialise(work.mapInArrow(run, TABLE_SCHEMA), "file_boundaries")
    p = planned(tables, stitched(tables).filter("total > 0"))
    p = p.select(F.col("doc").alias("path"), "piece", F.col("start").alias("byte_start"), F.col("end").alias("byte_end"), _named("cut").alias("cut"))
    # Pieces of one range of a file are read by one task, in order.
    p = p.repartition("path", F.floor(F.col("byte_start") / range_bytes)).sortWithinPartitions("path", "byte_start")
    rows = p.mapInArrow(emit, columns)
    return rows.withColumn("text", clean_text(F.col("text")))


def p4_found(spark, sf_dir: str) -> DataFrame:
    sections, configs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sections", "chunk_configs"))
    return split_texts(sections, configs).filter("piece = 0").select("section_id", "boundary")


def p4_pieces(spark, sf_dir: str) -> DataFrame:
    sections, configs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sections", "chunk_configs"))
    return pieces(sections, configs)


def p4_file_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents as text files in the shared folder, cut by byte range; (file, piece, cut, size in bytes, digest of the text)."""
    from vellum.session import shared_dir

    folder = f"{shared_dir(spark)}/texts-{zlib.crc32(sf_dir.encode()):08x}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("text").write.mode("overwrite").text(folder)
    paths = sorted(r[0] for r in spark.read.text(folder).select(F.input_file_name()).distinct().collect())  # names of files
    rows = split_files(spark, paths)
    return rows.select(F.substring(F.element_at(F.split("path", "/"), -1), 1, 10).alias("file"), "piece", "cut", (F.col("byte_end") - F.col("byte_start")).alias("bytes"), F.md5("text").alias("digest"))

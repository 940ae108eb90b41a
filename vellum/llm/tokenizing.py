"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works on code-point arrays: each code point gets a class, each
class is a function from the scanner's state to its next state, and these
functions are composed with an associative doubling scan. No regular expression
is run. The slices between the boundaries are looked up in a bounded cache of
already merged slices; only unseen slices are merged.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of code points. APOS2/APOS3 are apostrophes that head a contraction of
# two or three characters and are found by looking ahead.
LETTER, NUMBER, OTHER, BLANK, SPACE, APOS2, APOS3 = range(7)
# States: the kind of the token that the last character belongs to.
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_SPACE, S_C2, S_C3A, S_C3B = range(9)
N_STATES = 9
# Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the vocabulary's pre-tokeniser.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
CHARS_PER_SLICE = 1 << 20
MAX_CACHE = 400_000
CACHED_BYTES = 48


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    table[0x20] = BLANK
    return table


@lru_cache(1)
def transition_table() -> np.ndarray:
    """next_state[class, state]."""
    t = np.empty((7, N_STATES), np.uint8)
    for cls, state in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER), (BLANK, S_BLANK), (SPACE, S_SPACE)):
        t[cls] = state
    for cls, state in ((APOS2, S_C2), (APOS3, S_C3A)):
        t[cls] = state
        t[cls, [S_OTHER, S_BLANK]] = S_OTHER  # inside a run of symbols it is one of them
    t[LETTER, [S_C2, S_C3B]] = S_NONE  # the contraction ends here
    t[LETTER, S_C3A] = S_C3B
    return t


@lru_cache(1)
def begin_table() -> np.ndarray:
    """Whether a character begins a slice, by class * N_STATES + state before."""
    t = np.ones((7, N_STATES), bool)
    t[LETTER, [S_LETTER, S_BLANK, S_C2, S_C3A, S_C3B]] = False
    t[NUMBER, [S_NUMBER, S_BLANK]] = False
    for cls in (OTHER, APOS2, APOS3):
        t[cls, [S_OTHER, S_BLANK]] = False
    for cls in (BLANK, SPACE):
        t[cls, [S_BLANK, S_SPACE]] = False
    return t.ravel()


def scan_states(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """State before each character; ``starts`` marks first characters of texts.

    Each position holds the function of its window, as a row of N_STATES values.
    Windows double until every function is constant; as only contractions carry
    state further than one character, that takes few rounds on any text.
    """
    t = transition_table()
    # A function is constant if all states lead to one; most classes are from the start.
    out = t[:, S_NONE].copy()[classes]
    # A letter's function differs only after an apostrophe, so most letters are constant in effect.
    first = np.zeros(len(classes), bool)
    first[starts] = True
    varies = np.zeros(len(classes), bool)
    apos = np.flatnonzero(classes >= APOS2)
    varies[apos] = True
    for k in (1, 2):
        varies[np.minimum(apos + k, len(classes) - 1)] = True
    todo = np.flatnonzero(varies & ~first)
    funcs = t[classes[todo]]
    reach = todo - 1
    while len(todo):
        # Composition with the window that ends at ``reach``: known states or another pending function.
        pending = varies[reach] & ~first[reach]
        done = ~pending
        out[todo[done]] = np.take_along_axis(funcs[done], out[reach[done]][:, None].astype(np.int64), 1)[:, 0]
        todo, funcs, reach = todo[pending], funcs[pending], reach[pending]
        if not len(todo):
            break
        funcs = np.take_along_axis(funcs, t[classes[reach]].astype(np.int64), 1)
        same = (funcs == funcs[:, :1]).all(1)
        out[todo[same]] = funcs[same, 0]
        keep = ~same
        todo, funcs, reach = todo[keep], funcs[keep], reach[keep] - 1
    before = np.empty_like(out)
    before[0] = S_NONE
    before[1:] = out[:-1]
    before[starts] = S_NONE
    return before


def boundaries(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions at which a slice begins. ``starts``: first positions of non-empty texts, increasing."""
    n = len(cps)
    classes = class_table()[cps]
    last = np.zeros(n, bool)
    last[starts[1:] - 1] = True
    last[n - 1] = True
    apos = np.flatnonzero(cps == 0x27)
    if len(apos):
        one, two = np.minimum(apos + 1, n - 1), np.minimum(apos + 2, n - 1)
        inside1, inside2 = ~last[apos], ~last[apos] & ~last[one]
        a, b = cps[one], cps[two]
        short, long = np.zeros(len(apos), bool), np.zeros(len(apos), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                short |= inside1 & (a == ord(c[1]))
            else:
                long |= inside2 & (a == ord(c[1])) & (b == ord(c[2]))
        classes[apos[short]] = APOS2
        classes[apos[long]] = APOS3
    before = scan_states(classes, starts)
    begin = begin_table()[classes * N_STATES + before]
    white = (classes == BLANK) | (classes == SPACE)
    begin[:-1] |= white[:-1] & ~white[1:] & ~last[:-1]  # the last blank of a run goes with what follows
    begin[starts] = True
    return np.flatnonzero(begin)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is merged, leftmost first. O(n log n)."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        j = end[i]
        alive[j] = False
        end[i] = e
        if e < n:
            left[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := left[i]) >= 0:
            if (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes Arrow string arrays; one per Python worker."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self._reset()

    def _reset(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.start, self.count, self.flat = [0], [0], []

    def _add(self, piece: bytes) -> int:
        ids = merge(piece, self.ranks)
        self.start.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        k = len(self.start) - 1
        if len(piece) <= CACHED_BYTES:
            self.cache[piece] = k
        return k

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids per text, byte length of each id's slice within its text)."""
        if len(self.start) > MAX_CACHE:
            self._reset()
        data = b"".join(texts)
        n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.empty(0, np.int64)
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        # Byte offset of each code point: the bytes that don't continue one.
        at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
        ends = np.cumsum(n_bytes)
        first_byte = (ends - n_bytes)[n_bytes > 0]
        starts = np.searchsorted(at, first_byte)
        cuts = at[boundaries(cps, starts)]
        bounds = cuts.tolist()
        bounds.append(len(data))
        get, add = self.cache.get, self._add
        which = np.empty(len(cuts), np.int64)
        which[:] = [k if (k := get(p := data[a:b])) is not None else add(p) for a, b in zip(bounds, bounds[1:])]
        count = np.array(self.count, np.int64)[which]
        total = np.cumsum(count)
        source = np.repeat(np.array(self.start, np.int64)[which] - (total - count), count) + np.arange(total[-1])
        ids = np.array(self.flat, np.int32)[source]
        last_slice = np.searchsorted(cuts, ends)  # slices before each text's end
        upto = np.concatenate([[0], total])[last_slice]
        return ids, np.diff(upto, prepend=0), count


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes sum to about ``most``; a larger one stands alone."""
    a, n = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if n and n + s > most:
            yield a, i
            a, n = i, 0
        n += s
    if a < len(sizes):
        yield a, len(sizes)


def encode_corpus(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", ends: str | None = None) -> DataFrame:
    """All columns of ``df`` but ``text``, plus ``ids``: the token ids of each text.

    ``vocabulary`` is the path of a ``*.tiktoken`` rank file. No row is dropped;
    a null and an empty text give an empty list, a text of blanks is encoded as
    any other, strings that look like special tokens are ordinary text. ``ends``
    names a further column: where each token ends in the text's UTF-8 bytes. Equal
    rows stay separate rows. A column already named ``ids`` is replaced. Each
    row is encoded where it is read: no shuffle.
    """
    keep = [c for c in df.columns if c not in (text, ids, ends)]
    hidden = "__text__"
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(hidden))
    extra = [T.StructField(c, T.ArrayType(T.IntegerType()), True) for c in (ids, ends) if c]
    schema = T.StructType([*[df.schema[c] for c in keep], *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        width = _widths(vocabulary) if ends else None
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            size = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, np.int64)
            for a, b in _groups(size, CHARS_PER_SLICE):
                out, n, _ = encoder.encode([x or b"" for x in column.slice(a, b - a).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out, pa.int32()))
                part = batch.slice(a, b - a)
                columns = [*part.columns[:-1], lists]
                if width is not None:
                    upto = np.concatenate([[0], np.cumsum(width[out])])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array((upto[1:] - np.repeat(upto[offsets[:-1]], n)).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c for c in (*keep, ids, ends) if c])

    return source.mapInArrow(run, schema)


def _widths(vocabulary: str) -> np.ndarray:
    """Bytes of each token."""
    ranks = read_ranks(vocabulary)
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    out[list(ranks.values())] = [len(k) for k in ranks]
    return out


def decode_ids(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``text``: the text whose tokens ``ids`` holds. A null list gives null; unknown ids raise an error."""
    keep = [c for c in df.columns if c not in (ids, text)]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(text, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {v: k for k, v in read_ranks(vocabulary).items()}
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else b"".join(map(piece.__getitem__, x)).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text])

    return df.select(*[F.col(f"`{c}`") for c in [*keep, ids]]).mapInArrow(run, schema)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def p6_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_corpus(docs, vocabulary_path())

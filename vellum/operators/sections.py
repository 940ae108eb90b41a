"""Headings of page texts, sections between them, and chunks of the sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import heading, section_type, unwrapped, word_count

# Patterns of numbered headings, and of lines that are no heading.
ARABIC = r"^(\d{1,3}(?:\.\d{1,3}){0,4}\.?)\s+(.+)$"
ROMAN = r"(?i)^((?:I{1,4}|IV|VI{0,4}|IX|X{1,4}|XL|L|XC|C)\.?)\s+(.+)$"
LETTER = r"^([A-Z]\.?)\s+(.+)$"
CAPTION = r"(?i)^(?:fig(?:ure)?\.?|table|algorithm|listing|exhibit|plate|appendix\s+[a-z])\s*\d"
NOT_A_LINE = r"(?i)^\d{1,4}$|^\[\d+\]|^\s*\(\d{4}\)$|^(?:page\s+)?\d{1,4}\s*(?:/|of)\s*\d{1,4}$|^page\s+\d{1,4}$"
MATH = r"[=+\-*/^{}\\|∑∫∂≤≥≈×÷]"
MATH_SIGNS = "=+*^{}\\|∑∫∂"
SENTENCE = r"^\w{3,}\s+\w{3,}\s+\w{3,}.*\.$"
BIBLIOGRAPHY = (
    r"(?i)\bet al\b|\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\bdoi\b|https?://|www\.|\bissn\b|\bisbn\b|\bvol\.|\bpp\.|©|\bcopyright\b|\bpreprint\b|@|\barxiv\b"
    r"|\bvolume\s+\d+|\bissue\s+\d+|^[A-Z]{3,}[-\s]?\d{5,}\b|\blicen[cs]e\b|\bcc[- ]by\b"
)
AUTHORS = r"[A-Z][a-zA-Z'\-]+,\s*[A-Z]{1,2}\b\.?(?:\s*,|\s+[A-Z][a-z])"
ALL_CAPS = r"^[A-Z][A-Z\s\d:&/-]{2,}$"
WRAP_END = (
    "a an the and or of in on for to with by from as at via using based is are was were that which this these its their our into than between across under over such both while where"
).split()
# What headings of papers say.
KNOWN_HEADINGS = (
    "abstract|introduction|overview|motivation|preface|background|preliminaries|preliminary|basics|foundations|notation|definitions|problem statement|problem formulation|"
    "related work|related studies|related literature|related research|prior work|previous work|literature review|literature survey|survey|background and related work|background & related work|"
    "methodology|method|methods|proposed method|proposed approach|approach|framework|proposed framework|system overview|system description|architecture|materials and methods|materials & methods|"
    "technical approach|algorithm|dataset|datasets|data|data collection|data sources|data preprocessing|preprocessing|data preparation|corpus|data description|model|model architecture|"
    "network architecture|system design|system architecture|implementation|implementation details|technical details|design|experiments|experiment|experimental setup|experimental settings|setup|"
    "settings|configuration|baseline|baselines|evaluation setup|evaluation protocol|results|findings|results and discussion|results & discussion|analysis|quantitative results|qualitative results|"
    "performance|ablation study|ablation|case study|evaluation|performance evaluation|benchmark|discussion|discussion and conclusion|discussion and conclusions|limitations|limitations of the study|"
    "study limitations|limitations and future work|limitations & future work|limitations and future directions|limitations & future directions|future work|future directions|future research|"
    "research directions|research agenda|conclusion and future work|conclusions and future work|conclusion|conclusions|concluding remarks|final remarks|summary|summary and conclusion|"
    "summary and conclusions|summary & conclusions|references|bibliography|literature cited|works cited|reference list|acknowledgments|acknowledgements|acknowledgment|acknowledgement|appendix|"
    "appendices|supplementary material|supplementary materials|supplemental material|additional results|additional experiments|additional details|threat model|security analysis|attack model|"
    "ethics|ethical considerations|broader impact|social impact|reproducibility|related|our approach|our method|our model|proposed"
).split("|")
# Weights of what speaks for a heading, and the least sum.
ACCEPTED, LONGEST = 0.45, 120
LINE_END = r"\r\n|[\n\r\x0B\f\x85  ]"
EDGE = r"^[ \t\xA0]+|[ \t\xA0]+$"


def _starts_known() -> str:
    return "^(?:" + "|".join(re.escape(h).replace(r"\ ", " ").replace(r"\&", "&") for h in sorted((h for h in KNOWN_HEADINGS if len(h) > 4), key=len, reverse=True)) + r")\b"


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text."""
    return F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, EDGE, ""))


def _context(lines: Column) -> Column:
    """Lines with the one before and five behind; what lies outside is empty."""
    near = lambda i, k: F.coalesce(F.get(lines, i + k), F.lit(""))
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line"), F.when(i > 0, F.get(lines, i - 1)).otherwise("").alias("before"), *[near(i, k).alias(f"next{k}") for k in range(1, 6)]))


def _words(c: Column) -> Column:
    return F.size(F.split(c, r"\s+"))


def title_case(c: Column) -> Column:
    """Most of at most twelve words begin with a capital and aren't all capitals."""
    words = F.split(c, r"\s+")
    return (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}") & w.rlike(r"\p{Ll}"))) / F.size(words) >= 0.6) & (F.size(words) <= 12)


def heading_candidates(pages: DataFrame, paper: str = "paper_id", text: str = "text") -> DataFrame:
    """(paper, i, line, level, numbering, score): the lines of each text that score as headings.

    Lines are looked at in an array of their text, so nothing is shuffled. The
    blank lines around a line count only where fewer than 40 % of a text's lines
    stand alone. Null and empty texts have no heading.
    """
    # One step at a time: a column that a lambda names is computed once a row.
    rows = pages.filter(F.col(text).isNotNull()).select(paper, lines_of(F.col(text)).alias("lines")).select(paper, _context(F.col("lines")).alias("c"))
    alone = lambda x: (x["line"] != "") & (x["before"] == "") & (x["next1"] == "")
    full = F.size(F.filter("c", lambda x: x["line"] != ""))
    telling = (full == 0) | (F.size(F.filter("c", alone)) < 0.4 * full)
    maybe = F.filter("c", lambda x: (x["line"] != "") & (F.length(x["line"]) <= LONGEST) & ~x["line"].rlike(NOT_A_LINE) & ~x["line"].rlike(CAPTION))
    lines = rows.select(paper, telling.alias("telling"), F.explode(maybe).alias("x")).select(paper, "telling", "x.*")
    return scored_lines(lines).filter(F.col("score") >= ACCEPTED).select(paper, "i", "line", "level", "numbering", "score")


def scored_lines(lines: DataFrame) -> DataFrame:
    """Adds level, numbering and score to (line, before, next1 .. next5, telling) of lines that aren't captions."""
    line = F.col("line")
    arabic, roman, letter = line.rlike(ARABIC), line.rlike(ROMAN), line.rlike(LETTER)
    part = lambda k: F.when(arabic, F.regexp_extract(line, ARABIC, k)).when(roman, F.regexp_extract(line, ROMAN, k)).when(letter, F.regexp_extract(line, LETTER, k))
    t = lines.withColumn("body", F.trim(F.coalesce(part(2), line))).withColumn("numbering", F.rtrim(F.regexp_replace(F.coalesce(part(1), F.lit("")), r"\.+$", "")))
    t = t.withColumn("known", F.lower("body").isin(KNOWN_HEADINGS)).withColumn("words", _words(line)).withColumn("titled", line.rlike(ALL_CAPS) | title_case(line))
    body = F.col("body")
    item = (_words(body) > 12) | (body.endswith(".") & (_words(body) > 4)) | body.rlike(r"^\p{Ll}")
    numbered = F.when(arabic, F.when(~item, 0.5).otherwise(0.0)).when(roman, F.when(~item, 0.4).otherwise(0.0)).when(letter, F.when(F.col("known") | body.rlike(ALL_CAPS) | title_case(body), 0.35).otherwise(0.1)).otherwise(0.0)
    starts = F.lower(body).rlike(_starts_known())
    vocabulary = F.when(F.col("known"), 0.5).when(starts, 0.25).otherwise(0.0)
    short = F.when(F.col("words") <= 8, 0.15).when(F.col("words") <= 12, 0.05).otherwise(0.0)
    capital = F.when(line.rlike(ALL_CAPS) & (F.col("words") <= 6), 0.2).when(title_case(line), 0.1).otherwise(0.0)
    before, behind = F.col("telling") & (F.col("before") == ""), F.col("telling") & (F.col("next1") == "")
    isolated = F.when(before & behind, 0.2).when(before | behind, 0.08).otherwise(0.0)
    follower = F.coalesce(*[F.when(F.col(f"next{k}") != "", F.col(f"next{k}")) for k in (1, 2, 3)])
    prose = F.when(_words(follower) >= 6, 0.1).otherwise(0.0)
    more = sum((F.col(f"next{k}").rlike(ARABIC)).cast("int") for k in range(1, 6))
    listed = F.when(arabic & line.endswith(".") & (more >= 2), -0.35).otherwise(0.0)
    plain = F.when((F.col("numbering") == "") & ~F.col("known") & ~starts & ~F.col("titled"), -0.3).otherwise(0.0)
    signs = F.length(line) - F.length(F.translate(line, MATH_SIGNS, ""))
    last = F.regexp_replace(F.lower(F.element_at(F.split(body, r"\s+"), -1)), r"^[.:;]+|[.:;]+$", "")
    guarded = (
        (line.rlike(MATH) & ~F.col("known") & (signs > 0.05 * F.length(line)))
        | (line.rlike(SENTENCE) & (F.col("words") > 7))
        | (~F.col("known") & (line.rlike(BIBLIOGRAPHY) | line.rlike(AUTHORS) | body.rlike(r"^\p{Ll}") | line.rlike("[,;-]$") | last.isin(WRAP_END)))
    )
    score = F.round(F.least(F.lit(1.0), numbered + vocabulary + short + capital + isolated + prose + listed + plain), 6)
    level = F.when(arabic, F.size(F.split("numbering", r"\."))).otherwise(1)
    return t.withColumn("level", level.cast("int")).withColumn("score", F.when(guarded, 0.0).otherwise(score))


def extract_sections(pages: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, section_order, title, normalized_title, section_type, level, page_start, page_end, text, heading_confidence).

    ``pages``: (paper, page_number, text). A section is the lines behind a heading
    up to the next one; what stands before the first heading is left out, as
    front matter. A paper without any heading is one section "Document Body".
    """
    page = F.struct("page_number", lines_of(F.coalesce("text", F.lit(""))).alias("lines"))
    one = pages.filter(F.col(paper).isNotNull()).groupBy(paper).agg(F.array_sort(F.collect_list(page)).alias("p"))  # the pages of one paper
    flat = F.flatten(F.transform("p", lambda p: F.transform(p["lines"], lambda x: F.struct(p["page_number"].alias("page"), x.alias("line")))))
    one = one.select(paper, flat.alias("lines"))
    found = heading_candidates(one.select(paper, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text")), paper)
    heads = found.groupBy(paper).agg(F.array_sort(F.collect_list(F.struct("i", "line", "level", "score"))).alias("heads"))
    t = one.join(heads, paper, "left").withColumn("n", F.size("lines"))  # heads: few lines of one paper
    # Each line goes with its own section only, so a paper of many sections isn't copied for each.
    to = lambda k: F.coalesce(F.get(F.col("heads"), k + 1)["i"], F.col("n"))
    some = F.transform("heads", lambda h, k: F.struct(k.alias("section_order"), h["line"].alias("title"), h["level"].alias("level"), h["score"].alias("score"), h["i"].alias("at"), F.get("lines", h["i"])["page"].alias("own_page"), F.slice("lines", h["i"] + 2, to(k) - h["i"] - 1).alias("own")))
    none = F.array(F.struct(F.lit(0).alias("section_order"), F.lit("Document Body").alias("title"), F.lit(1).alias("level"), F.lit(0.0).alias("score"), F.lit(-1).alias("at"), F.get("lines", F.lit(0))["page"].alias("own_page"), F.col("lines").alias("own")))
    t = t.select(paper, F.when(F.col("heads").isNotNull(), some).otherwise(none).alias("s")).select(paper, F.explode("s").alias("h")).select(paper, "h.*")
    body = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    titled = heading(F.col("title"))
    kind = F.when(F.col("at") < 0, "UNKNOWN").otherwise(section_type(titled))
    first, last = F.coalesce("own_page", F.get("own", F.lit(0))["page"]), F.coalesce(F.array_max(F.transform("own", lambda x: x["page"])), "own_page")
    return t.select(paper, "section_order", "title", titled.alias("normalized_title"), kind.alias("section_type"), "level", first.alias("page_start"), last.alias("page_end"), body.alias("text"), F.col("score").alias("heading_confidence"))


def parent_sections(sections: DataFrame) -> DataFrame:
    """(paper_id, section_id, parent): the nearest section before of a smaller level, of the same paper; of any level."""
    w = Window.partitionBy("paper_id").orderBy("section_order").rowsBetween(Window.unboundedPreceding, -1)
    # One running last per level that occurs: no join of a paper's sections with themselves is needed.
    levels = sorted(r[0] for r in sections.select("section_level").filter("section_level is not null").distinct().limit(65).collect())
    if len(levels) > 64:
        raise ValueError("sections of more than 64 levels")
    seen = sections
    for level in levels:
        seen = seen.withColumn(f"_l{level}", F.last(F.when(F.col("section_level") == level, F.struct("section_order", "section_id")), ignorenulls=True).over(w))
    options = [F.when(F.col("section_level") > level, F.col(f"_l{level}")) for level in levels]
    best = F.greatest(*options) if len(options) > 1 else options[0] if options else F.lit(None).cast("struct<section_order:int,section_id:string>")
    return seen.select("paper_id", "section_id", best["section_id"].alias("parent"))


CHUNK_COLUMNS = "paper_id string, chunk_index int, section_order int, section_title string, section_type string, section_level int, page_start int, page_end int, text string, char_start int, char_end int"
PROTECTED = ("LIMITATIONS", "FUTURE_WORK")  # sections that stay by themselves however short
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(\[])")


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE_END.split(text.strip()) if s.strip()]


class Packer:
    """Packs the units of one section into chunks of about ``target`` characters with an overlap in front."""

    def __init__(self, target: int, limit: int, overlap: int):
        self.target, self.limit, self.overlap = target, limit, overlap
        self.out: list[tuple[str, int, int]] = []
        self.tail = ""

    def _carry(self, text: str) -> None:
        end = text[-self.overlap :] if self.overlap else ""
        whole = _sentences(end)
        self.tail = text if len(text) <= self.overlap else " ".join(whole[1:]) if len(whole) > 1 else end

    def _emit(self, body: str, between: str, start: int, end: int) -> str:
        text = f"{self.tail}{between}{body}".strip() if self.tail else body
        self.out.append((text, max(0, start), max(0, end)))
        return text

    def units(self, units: list[str], gap: int, at: int, deeper) -> None:
        """``gap``: characters between units in the section; ``deeper(unit, at)`` cuts a unit beyond the limit."""
        held: list[str] = []

        def flush() -> None:
            if held:
                size = sum(map(len, held)) + gap * (len(held) - 1)
                self._carry(self._emit("\n\n".join(held), "\n\n", at - size, at))
                held.clear()

        for u in units:
            if len(u) > self.limit:
                flush()
                n = len(self.out)
                deeper(u, at)
                if len(self.out) > n:
                    self._carry(self.out[-1][0])
            else:
                if held and sum(map(len, held)) + gap * len(held) + len(u) > self.target:
                    flush()
                held.append(u)
            at += len(u) + gap
        flush()

    def slices(self, text: str, at: int) -> None:
        for k in range(0, len(text), self.target):
            piece = text[k : k + self.target]
            if piece.strip():
                self._emit(piece, " ", at, at + len(piece))
                self._carry(piece)
                at += len(piece)


def fold_small(sections: list[dict], least: int) -> list[dict]:
    """Sections of fewer than ``least`` words joined to the one before, or the next; their title becomes text.

    Protected sections are never folded, and nothing short is folded into one from behind.
    """
    out: list[dict] = []
    waiting: list[dict] = []

    def join(a: dict, b: dict, into: dict) -> dict:
        return into | {"paragraphs": a["paragraphs"] + b["paragraphs"], "page_start": min(a["page_start"], b["page_start"]), "page_end": max(a["page_end"], b["page_end"])}

    def as_text(s: dict) -> dict:
        return s | {"paragraphs": [p for p in [s["title"].strip()] if p] + s["paragraphs"]}

    for s in sections:
        if least <= 0 or s["words"] >= least or s["section_type"] in PROTECTED:
            for early in reversed(waiting):
                s = join(as_text(early), s, s)
            waiting = []
            out.append(s)
        elif out and out[-1]["section_type"] not in PROTECTED:
            out[-1] = join(out[-1], as_text(s), out[-1])
        else:
            waiting.append(s)
    for k, s in enumerate(waiting):
        out.append(s) if not out else out.__setitem__(-1, join(out[-1], as_text(s), out[-1]))
    return out


def chunk_sections(sections: DataFrame, target: int = 2000, limit: int = 2400, overlap: int = 300, least_words: int = 60) -> DataFrame:
    """Chunks of each paper's sections, numbered through the paper, with a stable ``chunk_id``; chunks never cross a section.

    ``sections``: (paper_id, section_order, title, section_type, text) and, where
    known, section_level, page_start, page_end. Lines are joined to paragraphs,
    which are gathered up to ``target`` characters; a paragraph above ``limit`` is
    taken by sentences, a sentence above it by slices. A chunk begins with up to
    ``overlap`` characters of the one before, from a sentence's begin where there
    is one; they don't count for the target. A chunk of fewer than
    ``least_words`` words joins the one before where both hold at most 1.25
    ``limit``. ``char_start`` and ``char_end`` count in the section's joined text.
    Null and blank texts give no chunk; repeated rows of a section_order are
    sections of their own, in order of their text.
    """
    optional = lambda c, d: F.coalesce(F.col(c).cast("int"), F.lit(d)).alias(c) if c in sections.columns else F.lit(d).alias(c)
    paragraphs = F.filter(F.transform(F.split(unwrapped(F.col("text")), r"\n\n+"), lambda p: F.trim(p)), lambda p: p != "")
    rows = sections.filter(F.col("paper_id").isNotNull()).select(
        "paper_id", F.col("section_order").cast("int").alias("section_order"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("section_type", F.lit("UNKNOWN")).alias("section_type"),
        optional("section_level", 1), optional("page_start", 1), optional("page_end", 1), F.coalesce(paragraphs, F.array().cast("array<string>")).alias("paragraphs"), F.coalesce(word_count(F.col("text")), F.lit(0)).alias("words"),
    )

    def of_paper(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["paragraphs"] = pdf.paragraphs.map(list)
        ordered = sorted(pdf.to_dict("records"), key=lambda s: (s["section_order"], s["title"], s["paragraphs"]))
        out: list[tuple] = []
        for s in fold_small(ordered, least_words):
            p = Packer(target, limit, overlap)
            p.units(s["paragraphs"], 2, 0, lambda u, at, p=p: p.units(_sentences(u), 1, at, p.slices))
            kept: list[tuple[str, int, int]] = []
            for text, a, b in p.out:
                if kept and len(text.split()) < least_words and len(kept[-1][0]) + len(text) <= 1.25 * limit:
                    kept[-1] = (f"{kept[-1][0]}\n\n{text}", kept[-1][1], b)
                else:
                    kept.append((text, a, b))
            out += [(s["paper_id"], len(out) + k, s["section_order"], s["title"], s["section_type"], s["section_level"], s["page_start"], s["page_end"], *x) for k, x in enumerate(kept)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_COLUMNS.split(", ")])

    chunks = rows.groupBy("paper_id").applyInPandas(of_paper, CHUNK_COLUMNS)
    return chunks.select(
        F.sha2(F.concat_ws(":", "paper_id", "section_order", "chunk_index"), 256).alias("chunk_id"), "*", F.length("text").alias("character_count"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("token_count")
    )

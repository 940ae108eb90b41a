"""Queries on headings, extracted sections and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import sections as S
from vellum.sources.tables import table


def _pages(spark, d):
    """Sections as the pages of their papers: title, empty line, text."""
    t = table(spark, d, "sections").groupBy("section_id").agg(F.min_by(F.struct("paper_id", "section_order", "title", "text"), F.struct("section_order", "title", "text")).alias("s")).select("section_id", "s.*")
    return t.select("section_id", "paper_id", F.col("section_order").alias("page_number"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


def heading_candidates(spark, d):
    """Headings of every section's text with its title, by line and score."""
    found = S.heading_candidates(_pages(spark, d), "section_id")
    return found.select("section_id", F.col("i").alias("line_no"), F.md5("line").alias("line"), "level", "numbering", F.round("score", 4).alias("score"))


def section_extraction(spark, d):
    """Sections of every paper's pages, and how surely they were told."""
    s = S.extract_sections(_pages(spark, d))
    return s.groupBy("section_type").agg(F.count("*").alias("sections"), F.count_distinct("paper_id").alias("papers"), F.sum((F.col("heading_confidence") < 0.6).cast("int")).alias("unsure"), F.sum((F.col("text") != "").cast("int")).alias("with_text"))


def section_chunks(spark, d):
    """Chunks of all extracted sections, whose order, titles and pages they carry."""
    s = S.extract_sections(_pages(spark, d)).withColumnRenamed("level", "section_level")
    c = S.chunk_sections(s)
    return c.select("chunk_id", "paper_id", "chunk_index", "section_type", "page_start", "page_end", "char_start", "char_end", "character_count", "token_count")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def heading_sql() -> str:
    """The rules of heading_candidates over (id, text)."""
    r = lambda c, p: f"regexp_matches({c}, {_quoted(p)})"
    listed = lambda words: ", ".join(_quoted(w) for w in words)
    size = lambda c: rf"len(regexp_split_to_array({c}, '\s+'))"
    title = lambda c: rf"(len(list_filter(regexp_split_to_array({c}, '\s+'), lambda w: regexp_matches(w, '^\p{{Lu}}') AND regexp_matches(w, '\p{{Ll}}')))::DOUBLE / {size(c)} >= 0.6 AND {size(c)} <= 12)"
    part = lambda k: f"CASE WHEN ar THEN regexp_extract(line, {_quoted(S.ARABIC)}, {k}) WHEN ro THEN regexp_extract(line, {_quoted(S.ROMAN)}, {k}) WHEN le THEN regexp_extract(line, {_quoted(S.LETTER)}, {k}) END"
    nexts = ", ".join(f"coalesce(lead(line, {k}) OVER w, '') AS next{k}" for k in range(1, 6))
    more = " + ".join(f"{r(f'next{k}', S.ARABIC)}::INT" for k in range(1, 6))
    return rf"""ln AS (SELECT id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT id, regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM pg)),
st AS (SELECT id, i, regexp_replace(raw, '^[ \t\x{{A0}}]+|[ \t\x{{A0}}]+$', '', 'g') AS line FROM ln),
nx AS (SELECT id, i, line, coalesce(lag(line) OVER w, '') AS before, {nexts} FROM st WINDOW w AS (PARTITION BY id ORDER BY i)),
al AS (SELECT id, sum((line <> '')::INT) AS full_, sum((line <> '' AND before = '' AND next1 = '')::INT) AS alone FROM nx GROUP BY id),
cd AS (SELECT nx.*, full_ = 0 OR alone < 0.4 * full_ AS telling, {r('line', S.ARABIC)} AS ar, {r('line', S.ROMAN)} AS ro, {r('line', S.LETTER)} AS le FROM nx JOIN al USING (id)
 WHERE line <> '' AND length(line) <= {S.LONGEST} AND NOT {r('line', S.NOT_A_LINE)} AND NOT {r('line', S.CAPTION)}),
bd AS (SELECT *, trim(coalesce({part(2)}, line)) AS body, regexp_replace(coalesce({part(1)}, ''), '\.+$', '') AS numbering FROM cd),
kn AS (SELECT *, lower(body) IN ({listed(S.KNOWN_HEADINGS)}) AS known, {r('lower(body)', S._starts_known())} AS starts, {size('line')} AS words, {r('line', S.ALL_CAPS)} OR {title('line')} AS titled,
 {size('body')} > 12 OR (ends_with(body, '.') AND {size('body')} > 4) OR {r('body', r'^\p{Ll}')} AS item,
 CASE WHEN next1 <> '' THEN next1 WHEN next2 <> '' THEN next2 WHEN next3 <> '' THEN next3 END AS follower,
 regexp_replace(lower(regexp_split_to_array(body, '\s+')[-1]), '^[.:;]+|[.:;]+$', '', 'g') AS last_, telling AND before = '' AS b, telling AND next1 = '' AS n FROM bd),
sc AS (SELECT *, CASE WHEN ({r('line', S.MATH)} AND NOT known AND length(line) - length(translate(line, {_quoted(S.MATH_SIGNS)}, '')) > 0.05 * length(line)) OR ({r('line', S.SENTENCE)} AND words > 7)
 OR (NOT known AND ({r('line', S.BIBLIOGRAPHY)} OR {r('line', S.AUTHORS)} OR {r('body', r'^\p{Ll}')} OR {r('line', '[,;-]$')} OR last_ IN ({listed(S.WRAP_END)}))) THEN 0.0 ELSE round(least(1.0,
 CASE WHEN ar THEN CASE WHEN item THEN 0 ELSE 0.5 END WHEN ro THEN CASE WHEN item THEN 0 ELSE 0.4 END WHEN le THEN CASE WHEN known OR {r('body', S.ALL_CAPS)} OR {title('body')} THEN 0.35 ELSE 0.1 END ELSE 0 END
 + CASE WHEN known THEN 0.5 WHEN starts THEN 0.25 ELSE 0 END + CASE WHEN words <= 8 THEN 0.15 WHEN words <= 12 THEN 0.05 ELSE 0 END
 + CASE WHEN {r('line', S.ALL_CAPS)} AND words <= 6 THEN 0.2 WHEN {title('line')} THEN 0.1 ELSE 0 END + CASE WHEN b AND n THEN 0.2 WHEN b OR n THEN 0.08 ELSE 0 END
 + CASE WHEN {size('follower')} >= 6 THEN 0.1 ELSE 0 END - CASE WHEN ar AND ends_with(line, '.') AND {more} >= 2 THEN 0.35 ELSE 0 END
 - CASE WHEN numbering = '' AND NOT known AND NOT starts AND NOT titled THEN 0.3 ELSE 0 END), 6) END AS score FROM kn),
hd AS (SELECT id, i, line, (CASE WHEN ar THEN len(string_split(numbering, '.')) ELSE 1 END)::INT AS level, numbering, score FROM sc WHERE score >= {S.ACCEPTED})"""


PAGES_SQL = """one AS (SELECT section_id, min(struct_pack(o := section_order, t := title, x := text, p := paper_id)) AS s FROM sections GROUP BY section_id)"""
QUERIES = {f.__name__: f for f in (heading_candidates, section_extraction, section_chunks)}
ORACLES = {
    "heading_candidates": f"""WITH {PAGES_SQL}, pg AS (SELECT section_id AS id, coalesce(s.t, '') || chr(10) || chr(10) || coalesce(s.x, '') AS text FROM one), {heading_sql()}
SELECT id AS section_id, i::INT AS line_no, md5(line) AS line, level, numbering, round(score, 4)::DOUBLE AS score FROM hd""",
    "section_extraction": f"""WITH {PAGES_SQL}, pp AS (SELECT s.p AS paper_id, s.o AS o, coalesce(s.t, '') || chr(10) || chr(10) || coalesce(s.x, '') AS text FROM one),
pl AS (SELECT paper_id, o, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT paper_id, o, text, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM pp)),
fl AS (SELECT paper_id, o, regexp_replace(line, '^[ \\t\\x{{A0}}]+|[ \\t\\x{{A0}}]+$', '', 'g') AS line, row_number() OVER (PARTITION BY paper_id ORDER BY o, k) - 1 AS i FROM pl),
pg AS (SELECT paper_id AS id, string_agg(line, chr(10) ORDER BY i) AS text FROM fl GROUP BY paper_id), {heading_sql()},
nh AS (SELECT *, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM hd),
bo AS (SELECT nh.id, nh.i, nh.line AS title, nh.score, regexp_replace(regexp_replace(coalesce(string_agg(fl.line, chr(10) ORDER BY fl.i), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text
 FROM nh LEFT JOIN fl ON fl.paper_id = nh.id AND fl.i > nh.i AND fl.i < coalesce(nh.nxt, 1000000000) GROUP BY ALL),
fb AS (SELECT paper_id AS id, 'Document Body' AS title, 0.0 AS score, string_agg(line, chr(10) ORDER BY i) AS text FROM fl WHERE paper_id NOT IN (SELECT id FROM hd) GROUP BY paper_id),
nm AS (SELECT id, title, score, text, false AS fb FROM bo UNION ALL SELECT id, title, score, text, true FROM fb)
SELECT CASE WHEN fb THEN 'UNKNOWN' ELSE kind END AS section_type, count(*) AS sections, count(DISTINCT id) AS papers, sum((score < 0.6)::INT)::BIGINT AS unsure, sum((text <> '')::INT)::BIGINT AS with_text
FROM nm JOIN kinds ON kinds.raw = nm.title GROUP BY 1""",
}


def _kinds_sql() -> str:
    """Types of the titles that occur, by the heading and section rules."""
    from vellum.functions.text import HEADING_LOWER, SECTION_RULES

    lower = ", ".join(f"'{w}'" for w in HEADING_LOWER)
    case = " ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN '{k}'" for p, k in SECTION_RULES)
    arabic, roman, letter = r"^\d{1,3}(?:\.\d{1,3}){0,4}\.?\s+", r"(?i)^(?:I{1,4}|IV|VI{0,4}|IX|X{1,4}|XL|L|XC|C)\.?\s+", r"^[A-Z]\.?\s+"
    return f"""kinds AS (SELECT raw, CASE WHEN t = '' THEN 'UNKNOWN' {case} ELSE 'OTHER' END AS kind FROM (SELECT raw, lower(array_to_string(list_transform(regexp_split_to_array(b, '\\s+'), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({lower}) THEN lower(w) ELSE w END), ' ')) AS t
 FROM (SELECT DISTINCT title AS raw, trim(CASE WHEN regexp_matches(title, '{arabic}') THEN regexp_replace(title, '{arabic}', '') WHEN regexp_matches(title, '{roman}') THEN regexp_replace(title, '{roman}', '') ELSE regexp_replace(title, '{letter}', '') END) AS b FROM nm)))"""


ORACLES["section_extraction"] = ORACLES["section_extraction"].replace("\nSELECT CASE WHEN fb", f",\n{_kinds_sql()}\nSELECT CASE WHEN fb")

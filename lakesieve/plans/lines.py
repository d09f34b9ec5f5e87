"""Plans over lines of text: deduplication, normalisation, to-do lists, programs, logs, rows, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.functions import detect as X
from lakesieve.functions import text as T
from lakesieve.operators import dedupe as D
from lakesieve.operators.leaders import leader_lines
from lakesieve.operators.verify import line_checks
from lakesieve.plans import sqltext as Q
from lakesieve.plans.files import language_sql, sniff_sql
from lakesieve.session import spread, table


def _docs(spark: SparkSession, d: str, fmt: str | None = None) -> DataFrame:
    """The documents; or those of a format, which is sniffed where none is declared."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "format", "path"))
    if fmt is None:
        return docs
    sniffed = X.sniff_format(F.col("path"), T.eol(F.col("text")))["mode"]
    return docs.where((F.col("format") == fmt) | (F.col("format").isNull() & (sniffed == fmt)))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return D.positioned(_docs(spark, d))


def line_dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines of all documents with counts and first positions."""
    return D.unique_lines(D.keyed_lines(_lines(spark, d)), key_is_line=True)


def line_dedupe_caps(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_lines(D.keyed_lines(_lines(spark, d), ignore_case=True))


def line_dedupe_punct_ws(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_lines(D.keyed_lines(_lines(spark, d), ignore_punct=True, collapse_ws=True))


def line_filter_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return D.filtered(line_dedupe_exact(spark, d), "duplicates")


def line_filter_singletons(spark: SparkSession, d: str) -> DataFrame:
    return D.filtered(line_dedupe_exact(spark, d), "singletons").select("line", "pos")


def line_sorted_freq(spark: SparkSession, d: str) -> DataFrame:
    return D.ordered(D.filtered(line_dedupe_exact(spark, d), "duplicates"), "freq-desc").select("line", "n")


def line_stacked(spark: SparkSession, d: str) -> DataFrame:
    return D.stacked(line_dedupe_exact(spark, d)).select("line", "pos")


def line_stats(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    return D.stats(lines, D.unique_lines(D.keyed_lines(lines), key_is_line=True))


def line_bullets(spark: SparkSession, d: str) -> DataFrame:
    """Lines of Markdown documents compared without bullets."""
    keyed = D.keyed_lines(D.positioned(_docs(spark, d, "md")), bullets=True)
    return D.unique_lines(keyed)


def verify_lines(spark: SparkSession, d: str) -> DataFrame:
    return line_checks(line_stats(spark, d))


def log_strip(spark: SparkSession, d: str) -> DataFrame:
    """Lines of logs without what changes from line to line."""
    lines = T.lines_of(_docs(spark, d, "log"), "text", "doc_id")
    return lines.select("doc_id", "line_no", T.strip_log(T.raw_line(F.col("line"))).alias("key"))


def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_lines(D.keyed_lines(D.positioned(_docs(spark, d, "log")), fmt="log"))


def event_log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events rendered as log lines, deduplicated without times and ids."""
    e = table(spark, d, "events")
    line = T.log_line(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), F.concat(F.lit("/u/"), F.pmod("user_id", F.lit(50)).cast("string")), F.lit(200), detail=F.concat(F.lit("id="), F.col("event_id").cast("string")))
    return D.unique_lines(D.keyed_lines(e.select(F.col("event_id").alias("pos"), line.alias("line")), fmt="log"))


def todo_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_todos(D.keyed_lines(D.positioned(_docs(spark, d, "todo")), fmt="todo"))


def code_strip(spark: SparkSession, d: str) -> DataFrame:
    """Lines of programs without block comments, line comments of their language, indent and trailing separators."""
    return D.code_lines(_docs(spark, d, "code")).select("doc_id", "line_no", "key")


def code_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_lines(D.code_lines(_docs(spark, d, "code")).where("line <> ''").select("pos", "line", "key"))


def code_literals(spark: SparkSession, d: str) -> DataFrame:
    """Lines of programs compared without their literals, import lines first in upper case."""
    lines = D.code_lines(_docs(spark, d, "code"), strings=True, numbers=True, ignore_punct=True, collapse_ws=True).where("line <> ''")
    return D.imports_first(D.unique_lines(lines.select("pos", "line", "key")), "alpha-desc").select("line", "n", "pos")


def csv_row_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.csv_rows(_docs(spark, d, "csv"))


def json_canonical_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return D.unique_json(table(spark, d, "events"), "event_id", "props")


def leader_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Leaders among the lines of each document at a similarity of 0.7."""
    return leader_lines(_docs(spark, d), 0.7)


def word_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every request's text and its normalized result."""
    q = table(spark, d, "score_requests").where("text is not null").select("request_id", "text")
    r = table(spark, d, "score_results").groupBy("request_id").agg(F.min("normalized").alias("normalized"))
    return q.join(r, "request_id").select("request_id", F.round(T.jaccard(F.col("text"), F.col("normalized")), 6).alias("similarity"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("path is not null")
    p = T.path_normalize(F.col("path"))
    return docs.select("doc_id", p.alias("path"), T.basename(p).alias("base"), T.extension(p).alias("ext"), T.parent(p).alias("folder"))


def event_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "check_requests")
    return c.select("delivery_id", T.event_id(F.col("event_id")).alias("event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        line_dedupe_exact, line_dedupe_caps, line_dedupe_punct_ws, line_filter_duplicates, line_filter_singletons, line_sorted_freq, line_stacked, line_stats, line_bullets, verify_lines, log_strip,
        log_dedupe, event_log_dedupe, todo_dedupe, code_strip, code_dedupe, code_literals, csv_row_dedupe, json_canonical_dedupe, leader_dedupe, word_jaccard, path_parts, event_ids,
    )
}

_EXACT = f"SELECT line, count(*) AS n, min(pos) AS pos FROM ({Q.RAW}) GROUP BY line"


def _first(key: str, raw: str = Q.RAW) -> str:
    return f"SELECT arg_min(line, pos) AS line, count(*) AS n, min(pos) AS pos FROM (SELECT *, {key} AS key FROM ({raw})) GROUP BY key"


def _is(fmt: str) -> str:
    """Whether a document is of a format, sniffed where none is declared."""
    return f"(format = '{fmt}' OR (format IS NULL AND doc_id IN (SELECT doc_id FROM ({sniff_sql()}) WHERE mode = '{fmt}')))"


def _of(fmt: str, text: str = "text") -> str:
    """Lines that are not blank of the documents of a format, with position."""
    lines = f"SELECT doc_id, u.i - 1 AS line_no, u.l AS line FROM (SELECT doc_id, {text} AS text FROM documents WHERE {_is(fmt)} AND text IS NOT NULL), unnest(string_split({Q.eol('text')}, chr(10))) WITH ORDINALITY AS u(l, i)"
    return f"SELECT * FROM (SELECT doc_id * 16777216 + line_no AS pos, doc_id, line_no, {Q.raw_line('line')} AS line FROM ({lines}))"


def _cut(expr: str, *markers: str) -> str:
    for m in markers:
        expr = f"string_split({expr}, '{m}')[1]"
    return expr


def _programs() -> str:
    """Lines of programs with their keys, written from the profiles of the languages."""
    bare = Q.eol("text")
    for p in ("(?s)/\\*.*?\\*/", '(?s)""".*?"""', "(?s)'''.*?'''", "(?s)<!--.*?-->"):
        bare = Q.sub(bare, p)
    bare = f"CASE language WHEN 'powershell' THEN {Q.sub(bare, '(?s)<#.*?#>')} WHEN 'lua' THEN {Q.sub(bare, '(?s)--' + chr(92) + '[' + chr(92) + '[.*?' + chr(92) + ']' + chr(92) + ']')} ELSE {bare} END"
    cut = f"""CASE WHEN language IN ('javascript', 'typescript', 'go', 'rust', 'java', 'csharp', 'swift', 'dart') THEN {_cut('line', '//')}
      WHEN language IN ('python', 'ruby', 'shell', 'powershell', 'r') THEN {_cut('line', '#')} WHEN language IN ('sql', 'lua') THEN {_cut('line', '--')}
      WHEN language = 'php' THEN {_cut('line', '//', '#')} WHEN language = 'css' THEN line WHEN language = 'html' THEN {Q.sub('line', '<!--.*?-->')}
      ELSE {_cut('line', '//', '#', '--')} END"""
    key = Q.sub(Q.sub(Q.trim("cut"), f"^[{T.WS}]+"), f"[;,][{T.WS}]*$")
    return f"""SELECT doc_id * 16777216 + line_no AS pos, doc_id, line_no, line, {key} AS key, {Q.trim('cut')} AS cut FROM (SELECT *, {cut} AS cut FROM (
      SELECT doc_id, language, u.i - 1 AS line_no, {Q.raw_line('u.l')} AS line FROM (SELECT doc_id, language, {bare} AS text FROM documents JOIN ({language_sql()}) USING (doc_id) WHERE {_is('code')} AND text IS NOT NULL),
      unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(l, i)))"""


_TODO = Q.trim(Q.sub(Q.sub("line", T.CHECKBOX), T.TODO_PREFIX))
_LITERAL = Q.squeeze(Q.no_punct(Q.sub(Q.sub(Q.sub(Q.sub(Q.sub('cut', '["\'`].*?["\'`]', '""'), '\\b0x[0-9a-fA-F]+\\b', '0'), '\\b[0-9]+(?:\\.[0-9]+)?\\b', '0'), f'^[{T.WS}]+'), f'[;,][{T.WS}]*$')))
_STATS = f"SELECT (SELECT count(*) FROM ({Q.RAW})) AS total, (SELECT count(*) FROM ({Q.RAW})) - (SELECT count(DISTINCT line) FROM ({Q.RAW})) AS removed, (SELECT count(DISTINCT line) FROM ({Q.RAW})) AS remaining"
_CSV = f"SELECT doc_id, u.i - 1 AS line_no, u.l AS line FROM documents, unnest(string_split({Q.eol('text')}, chr(10))) WITH ORDINALITY AS u(l, i) WHERE {_is('csv')} AND text IS NOT NULL"
_EVENT_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' /u/' || (user_id % 50)::VARCHAR || ' status=200 id=' || event_id::VARCHAR"

ORACLES = {
    "line_dedupe_exact": _EXACT,
    "line_dedupe_caps": _first("lower(line)"),
    "line_dedupe_punct_ws": _first(Q.squeeze(Q.no_punct("line"))),
    "line_filter_duplicates": f"{_EXACT} HAVING count(*) > 1",
    "line_filter_singletons": f"SELECT line, min(pos) AS pos FROM ({Q.RAW}) GROUP BY line HAVING count(*) = 1",
    "line_sorted_freq": f"SELECT line, count(*) AS n FROM ({Q.RAW}) GROUP BY line HAVING count(*) > 1",
    "line_stacked": f"SELECT 'x' || count(*)::VARCHAR || ' ' || line AS line, min(pos) AS pos FROM ({Q.RAW}) AS r GROUP BY r.line",
    "line_stats": _STATS,
    "line_bullets": _first(Q.trim(Q.sub("line", T.BULLET)), f"SELECT * FROM ({_of('md')}) WHERE line <> ''"),
    "verify_lines": "SELECT * FROM (VALUES ('non_negative', true), ('remaining_at_most_total', true), ('something_remains', true), ('sums_up', true)) AS t(\"check\", ok)",
    "log_strip": f"SELECT doc_id, line_no::INTEGER AS line_no, {Q.strip_log('line')} AS key FROM ({_of('log')})",
    "log_dedupe": _first(Q.strip_log("line"), f"SELECT * FROM ({_of('log')}) WHERE line <> ''"),
    "event_log_dedupe": _first(Q.strip_log("line"), f"SELECT event_id AS pos, {_EVENT_LINE} AS line FROM events"),
    "todo_dedupe": f"SELECT coalesce(arg_max(line, pos) FILTER (WHERE done), arg_min(line, pos)) AS line, count(*) AS n, coalesce(max(pos) FILTER (WHERE done), min(pos)) AS pos FROM (SELECT *, {_TODO} AS key, contains(lower(line), '[x]') OR contains(upper(line), 'DONE:') AS done FROM ({_of('todo')}) WHERE line <> '') GROUP BY key",
    "code_strip": f"SELECT doc_id, line_no::INTEGER AS line_no, key FROM ({_programs()})",
    "code_dedupe": f"SELECT arg_min(line, pos) AS line, count(*) AS n, min(pos) AS pos FROM ({_programs()}) WHERE line <> '' GROUP BY key",
    "code_literals": f"SELECT arg_min(line, pos) AS line, count(*) AS n, min(pos) AS pos FROM (SELECT *, {_LITERAL} AS k FROM ({_programs()}) WHERE line <> '') GROUP BY k",
    "csv_row_dedupe": f"""WITH l AS ({_CSV}), q AS (SELECT *, coalesce(sum(length(line) - length(replace(line, chr(34), ''))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS open FROM l),
      g AS (SELECT *, max(CASE WHEN open = 0 THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM q), r AS (SELECT doc_id, row_no AS line_no, string_agg(line, chr(10) ORDER BY g.line_no) AS line FROM g GROUP BY 1, 2),
      f AS (SELECT * FROM r WHERE {Q.trim('line')} <> ''), h AS (SELECT doc_id, min(line_no) AS head FROM f GROUP BY 1) SELECT f.doc_id, min(line_no)::INTEGER AS pos, line AS row, count(*) AS n, min(line_no) = any_value(head) AS is_header FROM f JOIN h USING (doc_id) GROUP BY f.doc_id, line""",
    "json_canonical_dedupe": "SELECT replace(replace(props, ' ', ''), chr(10), '') AS key, count(*) AS n, min(event_id) AS \"first\", arg_min(props, event_id) AS item FROM events WHERE props IS NOT NULL GROUP BY 1",
    "word_jaccard": f"""SELECT request_id, round(CASE WHEN text = normalized THEN 1 WHEN len({Q.words('text')}) = 0 OR len({Q.words('normalized')}) = 0 THEN 0
      ELSE len(list_intersect({Q.words('text')}, {Q.words('normalized')})) / len(list_distinct(list_concat({Q.words('text')}, {Q.words('normalized')}))) END, 6) AS similarity
      FROM score_requests JOIN (SELECT request_id, min(normalized) AS normalized FROM score_results GROUP BY 1) USING (request_id) WHERE text IS NOT NULL""",
    "path_parts": "SELECT doc_id, p AS path, lower(string_split(p, '/')[-1]) AS base, regexp_extract(lower(string_split(p, '/')[-1]), '^.+(\\.[^.]*)$', 1) AS ext, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder FROM (SELECT doc_id, regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^/+', ''), '/+', '/', 'g') AS p FROM documents WHERE path IS NOT NULL)",
    "event_ids": f"SELECT delivery_id, CASE WHEN regexp_matches(s, '^[A-Za-z0-9._:@+=/-]{{1,128}}$') THEN s END AS event_id FROM (SELECT delivery_id, {Q.trim('event_id')} AS s FROM check_requests)",
}

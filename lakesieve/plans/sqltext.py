"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

import re

from lakesieve.functions.text import LB, LOG_STRIPS, PUNCTUATION, RB, TRACKERS, WS


def re2(pattern: str) -> str:
    """A pattern of the library as a quoted RE2 pattern: RE2's word boundary is ASCII already."""
    p = pattern.replace(LB, "\\b").replace(RB, "\\b")
    p = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p)
    return quoted(p)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, pattern: str, put: str = "") -> str:
    return f"regexp_replace({expr}, {re2(pattern)}, {quoted(put.replace('$1', chr(92) + '1'))}, 'g')"


def trim(expr: str) -> str:
    return sub(sub(expr, f"^[{WS}]+"), f"[{WS}]+$")


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, f'[{WS}]+', ' ')})"


def eol(expr: str) -> str:
    return f"regexp_replace({expr}, '\\r\\n?', chr(10), 'g')"


def raw_line(expr: str) -> str:
    return sub(f"replace({sub(expr, f'[{WS}]+$')}, chr(9), '    ')", f"^[{WS}]+")


def no_punct(expr: str) -> str:
    return f"translate({expr}, {quoted(PUNCTUATION)}, '')"


def strip_log(expr: str) -> str:
    for _, pattern, put in LOG_STRIPS:
        expr = sub(expr, pattern, put)
    return trim(sub(expr, f"[{WS}]{{2,}}", " "))


def spam_normalize(expr: str) -> str:
    expr = eol(f"coalesce({expr}, '')")
    for pattern in TRACKERS:
        expr = sub(expr, pattern, " ")
    return f"lower({squeeze(expr)})"


def fnv1a32(expr: str) -> str:
    units = f"flatten(list_transform(string_split({expr}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END))"
    fold = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform({units}, lambda u: u::BIGINT)), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
    return f"CASE WHEN {expr} = '' THEN '811c9dc5' ELSE lower(to_hex({fold})) END"


#: documents as lines: (doc_id, line_no, line).
LINES = f"SELECT doc_id, u.i - 1 AS line_no, u.l AS line FROM documents, unnest(string_split({eol('text')}, chr(10))) WITH ORDINALITY AS u(l, i) WHERE text IS NOT NULL"
#: Lines that are not blank, trimmed, with their position.
RAW = f"SELECT * FROM (SELECT doc_id * 16777216 + line_no AS pos, doc_id, {raw_line('line')} AS line FROM ({LINES})) WHERE line <> ''"


def words(expr: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({expr}), '[A-Za-z0-9_]+'))"

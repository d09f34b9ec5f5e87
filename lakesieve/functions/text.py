"""Text normalisers as Column expressions (N1-N20), and the JavaScript character classes they need.

Regular expressions follow ECMAScript: its white space class, ASCII word boundaries and an end that does not
match before a final line feed are spelled out, because Java's defaults differ. Null stays null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside of a class: ECMAScript white space.
WS = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: ASCII word boundary before, and after, a word character.
LB, RB = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# Fixed values of the formats: punctuation that comparison ignores, markers, names and patterns.
PUNCTUATION = ".,/#!$%^&*;:{}=-_`~()?\"'[]"
BULLET = f"^[{WS}]*(?:[*+-]|[0-9]+\\.)[{WS}]+"
CHECKBOX = f"^[{WS}]*(?:[*+-]|[0-9]+\\.)?[{WS}]*\\[[ xX_/]\\][{WS}]*"
TODO_PREFIX = f"^[{WS}]*(?i:TODO|DONE|WAITING|COMPLETED|CANCELLED|PENDING):[{WS}]*"
EVENT_ID = "^[A-Za-z0-9._:@+=/-]{1,128}\\z"
EMAIL = f"^[^{WS}@]+@[^{WS}@]+\\.[^{WS}@]+\\z"


def js_trim(c: Column) -> Column:
    """Without leading and trailing ECMAScript white space."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[{WS}]+\\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def eol(c: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(c, "\\r\\n?", "\n")


def raw_line(c: Column, keep_indent: bool = False) -> Column:
    """Right-trimmed, tabs as four spaces, left-trimmed unless ``keep_indent``."""
    s = F.replace(F.regexp_replace(c, f"[{WS}]+\\z", ""), F.lit("\t"), F.lit("    "))
    return s if keep_indent else F.regexp_replace(s, f"^[{WS}]+", "")


def compare_filter(c: Column, ignore_punct: bool = False, collapse_ws: bool = False) -> Column:
    """Without punctuation, then with single spaces."""
    s = F.translate(c, PUNCTUATION, "") if ignore_punct else c
    return squeeze(s) if collapse_ws else s


def case_key(c: Column, ignore_case: bool) -> Column:
    """N4."""
    return F.lower(c) if ignore_case else c


def strip_bullet(c: Column) -> Column:
    """Without one Markdown bullet or number."""
    return js_trim(F.regexp_replace(c, BULLET, ""))


# What is stripped from log lines, by switch, in this order.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
LOG_STRIPS: tuple[tuple[str, str, str], ...] = (
    ("dates", "\\[[0-9]{4}-[0-9]{2}-[0-9]{2}[^\\]]*\\]", ""),
    ("dates", "\\[[0-9]{2}:[0-9]{2}:[0-9]{2}[^\\]]*\\]", ""),
    ("dates", f"{LB}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?{RB}", ""),
    ("dates", f"{LB}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[{WS}]+[0-9]{{1,2}}[{WS}]+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}{RB}", ""),
    ("uuids", f"(?i){LB}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{RB}", ""),
    ("pids", f"(?i){LB}(?:PID|tid|thread|req|trace|tx|trans)[=:#]?[{WS}]*\\[?[0-9]+\\]?", ""),
    ("pids", f"(?i){LB}id[=:][{WS}]*\\[?[0-9]+\\]?", ""),
    ("sql", f"(?i)({LB}VALUES[{WS}]*\\()[{WS}]*[0-9]+[{WS}]*,[{WS}]*", "$1"),
    ("ips", f"{LB}(?:{_OCTET}\\.){{3}}{_OCTET}{RB}", ""),
    ("ips", f"{LB}(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}{RB}", ""),
    ("hex", f"{LB}0x[0-9a-fA-F]+{RB}", ""),
    ("levels", f"(?i)\\[?(?:INFO|WARN|WARNING|DEBUG|ERROR|TRACE|FATAL|CRITICAL)\\]?[:\\-]?[{WS}]*", ""),
    ("urls", "\\?[a-zA-Z0-9_=&%.\\-+]+", ""),
)


def strip_log(c: Column, switches: frozenset[str] | None = None) -> Column:
    """Without times, ids, numbers of processes, addresses, levels and URL queries (all switches by default)."""
    for switch, pattern, put in LOG_STRIPS:
        if switches is None or switch in switches:
            c = F.regexp_replace(c, pattern, put)
    return js_trim(F.regexp_replace(c, f"[{WS}]{{2,}}", " "))


def strip_todo(c: Column, state: bool = True, prefixes: bool = True) -> Column:
    """Without checkbox and state word."""
    if state:
        c = F.regexp_replace(c, CHECKBOX, "")
    if prefixes:
        c = F.regexp_replace(c, TODO_PREFIX, "")
    return js_trim(c)


def strip_blocks(c: Column, language: Column | None = None) -> Column:
    """A whole text without block comments and docstrings; ``language`` adds those of PowerShell and Lua."""
    for pattern in ("(?s)/\\*.*?\\*/", '(?s)""".*?"""', "(?s)'''.*?'''", "(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, "")
    if language is not None:
        c = F.when(language == "powershell", F.regexp_replace(c, "(?s)<#.*?#>", "")).when(language == "lua", F.regexp_replace(c, "(?s)--\\[\\[.*?\\]\\]", "")).otherwise(c)
    return c


def cut_at(c: Column, *markers: str) -> Column:
    """Cut at the first occurrence of each marker in turn (not aware of strings), trimmed."""
    for m in markers:
        c = F.substring_index(c, m, 1)
    return js_trim(c)


# What begins a comment that ends with its line, by language.
LINE_COMMENTS = {
    "//": ("javascript", "typescript", "go", "rust", "java", "csharp", "swift", "dart"),
    "#": ("python", "ruby", "shell", "powershell", "r"),
    "--": ("sql", "lua"),
}


def strip_line_comments(c: Column, language: Column) -> Column:
    """A line of ``language`` without its comment, trimmed. PHP has // and #, HTML and CSS have none that end with
    the line (HTML loses comments that begin and end in it), a language that is not known has //, # and --."""
    out = F.when(language == "php", cut_at(c, "//", "#")).when(language == "css", js_trim(c))
    out = out.when(language == "html", js_trim(F.regexp_replace(c, "<!--[^\\n\\r\\u2028\\u2029]*?-->", "")))
    for marker, languages in LINE_COMMENTS.items():
        out = out.when(language.isin(*languages), cut_at(c, marker))
    return out.otherwise(cut_at(c, "//", "#", "--"))


def code_metadata(c: Column, strings: bool = False, numbers: bool = False) -> Column:
    """String literals as \"\", numbers as 0."""
    if strings:
        c = F.regexp_replace(c, "[\"'`][^\\n\\r\\u2028\\u2029]*?[\"'`]", '""')
    if numbers:
        c = F.regexp_replace(F.regexp_replace(c, f"{LB}0x[0-9a-fA-F]+{RB}", "0"), f"{LB}[0-9]+(?:\\.[0-9]+)?{RB}", "0")
    return c


def code_edges(c: Column) -> Column:
    """Without indent and without a trailing separator."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{WS}]+", ""), f"[;,][{WS}]*\\z", "")


def comparison_key(c: Column, fmt: str = "txt", ignore_case: bool = False, ignore_punct: bool = False, collapse_ws: bool = False, bullets: bool = False, language: Column | None = None) -> Column:
    """The key that lines of a format are compared by.

    A line of code loses its comment by ``language``, or by the language that the line itself shows; a line of JSON
    that parses is compared in canonical form.
    """
    s = raw_line(c)
    if fmt == "log":
        s = strip_log(s)
    elif fmt == "todo":
        s = strip_todo(s)
    elif fmt == "code":
        from lakesieve.functions.detect import detect_language

        s = code_edges(strip_line_comments(s, detect_language(F.lit(""), s) if language is None else language))
    elif fmt == "json":
        from lakesieve.functions.jsonx import strict_canonical

        s = F.when(s.startswith("{") | s.startswith("["), strict_canonical(s)).otherwise(s)
    elif fmt == "txt" and bullets:
        s = strip_bullet(s)
    return case_key(compare_filter(s, ignore_punct, collapse_ws), ignore_case)


# Trackers that spam normalisation blanks, in this order.
TRACKERS: tuple[str, ...] = (
    f"{LB}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:?[0-9]{{2}})?{RB}",
    f"(?i){LB}(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?[{WS}]+[0-9]{{1,2}}[{WS}]+[A-Za-z]{{3}}[{WS}]+[0-9]{{4}}{RB}",
    f"(?i){LB}[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}{RB}",
    f"{LB}(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}{RB}",
    f"[?&][^={WS}&]+=[^&{WS}]*",
)

#: Cheap patterns that match wherever the tracker at the same place does.
TRACKER_HINTS = ("[0-9]:[0-9]{2}:[0-9]", f"[0-9][{WS}]+[A-Za-z]{{3}}[{WS}]+[0-9]{{4}}", "[0-9A-Fa-f]{8}-", "[0-9]\\.[0-9]+\\.", "[?&]")


def _guarded(hint: str, pattern: str):
    return lambda x: F.when(x.rlike(hint), F.regexp_replace(x, pattern, " ")).otherwise(x)


def spam_normalize(c: Column, strip_trackers: Column | bool = True) -> Column:
    """One line, lower case, trackers blanked where ``strip_trackers`` is not false."""
    base = eol(F.coalesce(c, F.lit("")))
    bare = base
    for hint, pattern in zip(TRACKER_HINTS, TRACKERS, strict=True):
        bare = F.get(F.transform(F.array(bare), _guarded(hint, pattern)), F.lit(0))
    if isinstance(strip_trackers, bool):
        return F.lower(squeeze(bare if strip_trackers else base))
    return F.lower(squeeze(F.when(F.coalesce(strip_trackers, F.lit(True)), bare).otherwise(base)))


def path_normalize(c: Column) -> Column:
    """N14."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", ""), "/+", "/")


def basename(c: Column) -> Column:
    """The last segment, lower case."""
    return F.lower(F.substring_index(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1))


def extension(c: Column) -> Column:
    """The extension with its dot; none for names that begin with their only dot."""
    return F.regexp_extract(basename(c), "^.+(\\.[^.]*)\\z", 1)


def parent(c: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(c, "^(.*)/[^/]*\\z", 1)


def block_norm(c: Column) -> Column:
    """A code block on one line; null below 16 characters."""
    s = squeeze(c)
    return F.when(F.length(s) >= 16, s)


def event_id(c: Column) -> Column:
    """The trimmed id if it is valid, else null."""
    s = js_trim(c)
    return F.when(s.rlike(EVENT_ID), s)


def blocklist(c: Column, most: int = 500, longest: int = 200) -> Column:
    """A list of phrases, trimmed, without blanks and overlong ones, at most ``most``."""
    phrases = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), js_trim), lambda x: (x != "") & (F.length(x) <= longest))
    return F.slice(phrases, 1, most)


def email_normalize(c: Column) -> Column:
    """Trimmed lower-case address, null if it isn't one."""
    s = F.lower(js_trim(c))
    return F.when(s.rlike(EMAIL) & (F.length(s) <= 254), s)


def log_line(ts: Column, method: Column, path: Column, status: Column, decision: Column | None = None, score: Column | None = None, duplicate: Column | None = None, detail: Column | None = None) -> Column:
    """One line of a request log; missing parts are left out."""
    parts = [ts, method, path, F.concat(F.lit("status="), status.cast("string"))]
    if decision is not None:
        parts.append(F.concat(F.lit("decision="), decision))
    if score is not None:
        parts.append(F.concat(F.lit("score="), score.cast("string")))
    if duplicate is not None:
        parts.append(F.when(duplicate, F.lit("duplicate=true")))
    if detail is not None:
        parts.append(detail)
    return F.concat_ws(" ", *parts)


def word_set(c: Column) -> Column:
    """M1: the distinct lower-case ASCII words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """M2: 1 for equal texts, 0 if either has no words, else shared words / all words."""
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def lines_of(df, text: str = "text", *keep: str):
    """(``keep``..., line_no, line): the lines of a text column, counted from 0; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(eol(F.col(text)), "\n")).alias("line_no", "line"))

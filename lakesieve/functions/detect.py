"""Format and language detection (D1-D4) by extension and content, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesieve.functions.jsonx import valid_json
from lakesieve.functions.spamrules import let
from lakesieve.functions.text import LB, RB, WS, basename, extension

# Extensions by kind, in their usual order.
CODE = (
    ".js .ts .jsx .tsx .mjs .cjs .py .pyw .pyi .java .kt .kts .scala .sc .groovy .gradle .cpp .cc .cxx .c .h .hpp .hxx .cs .fs .fsx .vb .go .rs .rb .php .swift .m .mm .r .jl .lua .pl .pm"
    " .sh .bash .zsh .fish .ps1 .psm1 .bat .cmd .css .scss .sass .less .styl .html .htm .xhtml .vue .svelte .astro .elm .clj .cljs .ex .exs .erl .hrl .hs .lhs .dart .zig .nim .v .vh .sv"
    " .tcl .awk .sql .graphql .gql .proto .tf .hcl .sol .move"
).split()
DATA = {
    "csv": ".csv .tsv .psv .ssv .tab".split(),
    "json": ".json .jsonl .ndjson .geojson .yaml .yml .xml .toml".split(),
    "log": ".log .sql .audit .trace .out .err".split(),
    "todo": ".todo .list .task .tasks .checklist".split(),
    "excel": ".xlsx .xls .xlsm .ods".split(),
    "txt": ".txt .text .md .markdown .rst .adoc .org .rtf .ini .cfg .conf .properties .env .env.local .gitignore .dockerignore .editorconfig .prettierrc .eslintrc".split(),
}
SKIP = (
    ".png .jpg .jpeg .gif .webp .ico .bmp .svg .woff .woff2 .ttf .eot .otf .mp3 .mp4 .wav .avi .mov .webm .pdf .exe .dll .so .dylib .bin .dat .zip .gz .tar .7z .rar .bz2 .xz .wasm .map"
    " .class .jar .pyc .pyo .o .a .lib"
).split()
# Fixed values: (mode, weight, pattern) of what content shows; (?m) makes ^ and $ work per line.
S = f"[{WS}]"
SIGNALS = (
    ("log", 12, "\\[[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), ("log", 10, f"(?i){LB}(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL){RB}[^\\n\\r]*{LB}(?:pid|req|trace)="),
    ("log", 9, f"(?m)^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{S}+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"), ("log", 8, f"(?i){LB}(?:nginx|apache|syslog){RB}"), ("log", 8, f"(?i){LB}VALUES{S}*\\("),
    ("json", 11, f"(?m)^{S}*[\\[{{](?s:.)*[\\]}}]{S}*$"), ("json", 9, f"(?m)^{S}*\\{{[^}}]+\\}}{S}*$"), ("json", 7, f"(?m)^{S}*[A-Za-z0-9_.-]+:{S}*[^\\n\\r]+$"),
    ("todo", 10, f"(?m)^{S}*(?:[*+-]|[0-9]+\\.)?{S}*\\[[ xX_/]\\]"), ("todo", 9, f"(?im)^{S}*(?:TODO|DONE|WAITING|COMPLETED|PENDING):"),
    ("csv", 8, "(?m)^[^,\\n]+,[^,\\n]+,[^,\\n]+"), ("csv", 7, "(?m)^[^\\t\\n]+\\t[^\\t\\n]+\\t"),
    ("code", 8, f"(?m)^{S}*(?:import|from|require|use|#include|package|namespace){S}+"), ("code", 7, f"(?m)^{S}*(?:def|function|func|fn|class|interface|struct){S}+[A-Za-z0-9_]+"), ("code", 6, f"(?m)^{S}*(?://|#|--){S}+"),
    ("txt", 3, f"(?m)^{S}*(?:[*+-]|[0-9]+\\.){S}+[^{WS}]"),
)
MODES = ("txt", "csv", "json", "log", "todo", "excel", "code")
W = lambda *words: tuple(f"{LB}{w}{RB}" for w in words)
# Language, its extensions, import patterns and keywords.
LANGUAGES = (
    ("javascript", ".js .mjs .cjs .jsx", (f"^{S}*(?:import|export|require){RB}",), W("function", "const", "let", "var", "class")),
    ("typescript", ".ts .tsx", (f"^{S}*(?:import|export){RB}", f":{S}*[A-Za-z0-9_]+(?:\\[\\])?(?:{S}*[;,=]|\\z)"), W("interface", "type", "enum")),
    ("python", ".py .pyw .pyi", (f"^{S}*(?:import|from){S}+[A-Za-z0-9_]+",), W("def", "class", "self", "elif")),
    ("ruby", ".rb", (f"^{S}*(?:require|include){RB}",), W("def", "end", "module")),
    ("go", ".go", (f"^{S}*import{S}+\\(", f'^{S}*import{S}+"'), W("func", "package", "go")),
    ("rust", ".rs", (f"^{S}*(?:use|mod|extern{S}+crate){RB}",), W("fn", "let", "mut", "impl")),
    ("java", ".java .kt .kts .scala .sc .groovy", (f"^{S}*import{S}+[A-Za-z0-9_.]+",), W("public", "class", "void", "fun")),
    ("csharp", ".cs .fs .fsx .vb", (f"^{S}*using{S}+[A-Za-z0-9_.]+",), W("namespace", "class")),
    ("php", ".php", (f"^{S}*(?:use|require|include){RB}",), (*W("function", "namespace"), "<\\?php")),
    ("shell", ".sh .bash .zsh .fish", (f"^{S}*source{S}+",), W("fi", "done", "esac")),
    ("powershell", ".ps1 .psm1", (f"(?i)^{S}*(?:Import-Module|using{S}+namespace){RB}",), ("\\$[A-Za-z0-9_]+", f"-[A-Za-z0-9_]+{S}")),
    ("sql", ".sql", (), (f"(?i){LB}SELECT{RB}", f"(?i){LB}INSERT{RB}", f"(?i){LB}CREATE{S}+TABLE{RB}", f"(?i){LB}VALUES{S}*\\(")),
    ("html", ".html .htm .xhtml .vue .svelte .astro", (), ("<[a-zA-Z][^>]*>", "</[A-Za-z0-9_]+>")),
    ("css", ".css .scss .sass .less .styl", (f"@import{RB}",), ("\\{[^}]*:[^}]*\\}", f"@media{RB}")),
    ("lua", ".lua", (f"^{S}*(?:require|local){RB}",), W("function", "end", "local")),
    ("r", ".r", (f"^{S}*(?:library|require){S}*\\(",), ("<-", f"{LB}function{S}*\\(")),
    ("swift", ".swift", (f"^{S}*import{S}+[A-Za-z0-9_]+",), W("func", "var", "let")),
    ("dart", ".dart", (f"^{S}*import{S}+'",), W("void", "class")),
)


def _points(cond: Column, n: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)


def sniff_scores(path: Column, content: Column) -> dict[str, Column]:
    """Points of every mode. Only the first 16000 characters of the content count, as specified."""
    ext, base = extension(F.coalesce(path, F.lit(""))), basename(F.coalesce(path, F.lit("")))
    has = ext != ""
    sample = F.substring(F.coalesce(content, F.lit("")), 1, 16000)  # nothing beyond is looked at
    blank = F.regexp_replace(sample, f"{S}+", "") == ""
    scores = {m: F.lit(0) for m in MODES}
    scores["txt"] = scores["txt"] + 1
    for mode, extensions in DATA.items():
        scores[mode] = scores[mode] + _points(has & ext.isin(*extensions), 20)
    scores["code"] += _points(has & ext.isin(*CODE), 18)
    scores["csv"] += _points(ext.isin(".tsv", ".tab"), 5)
    scores["json"] += _points(ext.isin(".ndjson", ".jsonl"), 5)
    scores["txt"] += _points(ext.isin(".md", ".markdown"), 8)
    scores["todo"] += _points(has & (base.contains("todo") | base.contains("shopping")), 6)
    named = F.when((base == "dockerfile") | base.startswith("dockerfile.") | base.isin("makefile", "gnumakefile"), 15).when(base.isin("rakefile", "gemfile", "podfile"), 12).otherwise(0)
    scores["code"] += F.when(~has, named).otherwise(0)
    scores["txt"] += F.when(~has & ((base == ".env") | base.endswith(".env")), 7).otherwise(0)
    for mode, weight, pattern in SIGNALS:
        scores[mode] = scores[mode] + _points(~blank & sample.rlike(pattern), weight)
    lines = F.slice(F.split(sample, "\n"), 1, 40)
    cells = lambda d: lambda x: (F.regexp_replace(x, f"{S}+", "") != "") & (F.size(F.split(x, d)) >= 3)
    for delimiter in (",", "\t"):
        rows = F.size(F.filter(lines, cells(delimiter)))
        scores["csv"] = scores["csv"] + _points(~blank & (rows >= 2) & (rows >= F.size(lines) * 0.4), 10)
    t = F.regexp_replace(F.regexp_replace(sample, f"^{S}+", ""), f"{S}+\\z", "")
    closed = (t.startswith("[") & t.endswith("]")) | (t.startswith("{") & t.endswith("}"))
    scores["json"] += _points(closed & valid_json(t), 15)
    parsed = F.size(F.filter(F.slice(lines, 1, 20), lambda x: (F.regexp_replace(x, f"{S}+", "") != "") & valid_json(x)))
    scores["json"] += _points(~blank & (parsed >= 2), 12)
    return scores


def sniff_format(path: Column, content: Column) -> Column:
    """D3: struct (mode, confidence); ``skip`` for binary extensions. Ties go to the mode listed first."""

    def pick(best: Column) -> Column:
        skip = extension(F.coalesce(path, F.lit(""))).isin(*SKIP)
        return F.struct(F.when(skip, "skip").otherwise(best["mode"]).alias("mode"), F.when(skip, 1.0).otherwise(F.least(F.lit(1.0), best["score"] / 25)).alias("confidence"))

    def rank(sample: Column) -> Column:
        scores = sniff_scores(path, sample)
        return F.array_max(F.array(*(F.struct(scores[m].alias("score"), F.lit(-i).alias("rank"), F.lit(m).alias("mode")) for i, m in enumerate(MODES))))

    return let(let(F.substring(F.coalesce(content, F.lit("")), 1, 16000), rank), pick)


def detect_language(path: Column, content: Column) -> Column:
    """The language of a program by extension, imports and keywords in its first 8000 characters, as specified."""
    ext = extension(F.coalesce(path, F.lit("")))
    return let(F.substring(F.coalesce(content, F.lit("")), 1, 8000), lambda sample: _language(ext, sample))


def _language(ext: Column, sample: Column) -> Column:
    ranked = []
    for i, (name, extensions, imports, keywords) in enumerate(LANGUAGES):
        score = _points(ext.isin(*extensions.split()), 25)
        for pattern, points in (*((p, 8) for p in imports), *((p, 4) for p in keywords)):
            score = score + _points(sample.rlike(pattern), points)
        ranked.append(F.struct(score.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")))
    return let(F.array_max(F.array(*ranked)), lambda best: F.when(best["score"] > 0, best["name"]).otherwise("generic"))


def legacy_format(content: Column) -> Column:
    """The format that the first 15 lines show; used where the sniffed one is not sure enough."""
    t = F.regexp_replace(F.regexp_replace(content, f"^{S}+", ""), f"{S}+\\z", "")
    lines = F.split(t, "\n")
    head = F.array_join(F.slice(lines, 1, 15), "\n")
    ends = F.regexp_replace(head, f"{S}+\\z", "")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    cells = lambda x: F.size(F.split(x, ","))
    return (
        F.when(head.rlike("\\[[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]") | head.rlike(f"(?i){LB}PID[:=]?{S}*\\[?[0-9]+|{LB}VALUES{S}*\\("), "log")
        .when((ends.startswith("{") & ends.endswith("}")) | (ends.startswith("[") & ends.endswith("]")), "json")
        .when(head.rlike(f"^{S}*(?:[*+-]|[0-9]+\\.)?{S}*\\[[ xX_/]\\]|^(?i){S}*(?:TODO|DONE|WAITING|COMPLETED):{S}*"), "todo")
        .when(head.rlike(f"{LB}(?:import|export|function|const|let|var|class|def|return){RB}|^{S}*(?://|#){S}+"), "code")
        .when((F.size(lines) > 1) & (cells(first) > 2) & (cells(second) == cells(first)), "csv")
        .otherwise("txt")
    )


def detected_format(path: Column, content: Column, threshold: float = 0.2) -> Column:
    """The sniffed format where its confidence reaches ``threshold``, else what the first lines show."""
    sniffed = sniff_format(path, content)
    return F.when(sniffed["confidence"] >= threshold, sniffed["mode"]).otherwise(legacy_format(content))

"""Plans over files: format and language, skip rules, duplicates, lines across files, code blocks, and media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesieve.functions import detect as X
from lakesieve.functions import text as T
from lakesieve.functions.jsonx import rendered
from lakesieve.operators import folder as P
from lakesieve.operators import media as M
from lakesieve.operators import mediarun as V
from lakesieve.operators.project import process_project
from lakesieve.plans import sqltext as Q
from lakesieve.session import spread, table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "path", F.col("text").alias("content")))


def _programs(spark: SparkSession, d: str) -> DataFrame:
    """The files of any code format, by their extension."""
    return _files(spark, d).where(T.extension(F.col("path")).isin(*X.CODE))


def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    s = X.sniff_format(F.col("path"), T.eol(F.col("content")))
    return _files(spark, d).select("doc_id", s.alias("s")).select("doc_id", "s.mode", F.round("s.confidence", 4).alias("confidence"))


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", X.detect_language(F.col("path"), T.eol(F.col("content"))).alias("language"))


RULES = "projects # a folder\n*.eml\nshared/2023\nbackup/r*"


def path_skip(spark: SparkSession, d: str) -> DataFrame:
    """Which files rules and folder switches leave out."""
    return _files(spark, d).where("path is not null").select("doc_id", P.skipped(F.col("path"), P.skip_rules(RULES)).alias("skipped"), P.ignored(F.col("path")).alias("ignored"))


def exact_file_dups(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_files(_files(spark, d)).select("path", "copies", "kept", "canonical")


def folder_summary(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return P.folder_stats(files, P.duplicate_files(files))


def cross_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that another file has already, by file."""
    one = _files(spark, d).where("path is not null").groupBy("path").agg(F.min_by("content", "doc_id").alias("content"))
    return P.cross_file_lines(one).groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.when(~F.col("kept"), 1).otherwise(0)).cast("long").alias("removed"))


def media_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of documents taken as media, with an extension by their id: kind, type, and whether they are left out."""
    ext = F.element_at(F.array(*(F.lit(e) for e in (".jpg", ".PNG", ".mov", ".txt", "", ".3gp"))), (F.col("doc_id") % 6 + 1).cast("int"))
    p = table(spark, d, "documents").where("path is not null").select("doc_id", F.concat("path", ext).alias("path"))
    return p.select("doc_id", V.media_kind(F.col("path")).alias("kind"), V.mime_type(F.col("path")).alias("mime"), V.media_ignored(F.col("path")).alias("ignored"))


def media_run(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images with variants, deduplicated by the whole gate and score."""
    null = lambda kind: F.lit(None).cast(kind)
    items = _media(spark, d).select(
        "path", F.lit("image").alias("kind"), null("string").alias("exact_hash"), "dhash", F.col("dhash").alias("ahash"), *(null("long").alias(h) for h in ("block_hash", "detail_hash", "color_hash")),
        null("array<bigint>").alias("frame_hashes"), F.lit(8).alias("width"), F.lit(8).alias("height"), "bytes", null("array<double>").alias("hue"), null("double").alias("luma"), null("double").alias("saturation"),
        null("array<struct<dhash:bigint,color_hash:bigint,detail_hash:bigint,hue:array<double>,luma:double,contrast:double>>").alias("frames"), null("double").alias("duration"),
    )
    return V.dedupe_media(items).groupBy("component").agg(F.count("*").alias("members"), F.max(F.when(F.col("kept"), F.col("path"))).alias("kept")).select("members", "kept")


def first_lines_format(spark: SparkSession, d: str) -> DataFrame:
    """The format that the first lines of documents show."""
    return _files(spark, d).where("content is not null").select("doc_id", X.legacy_format(F.col("content")).alias("format"))


def folder_project(spark: SparkSession, d: str) -> DataFrame:
    """A whole folder run on the documents: what became of every file."""
    files, _ = process_project(table(spark, d, "documents"), "safe", content="text")
    return files.select("path", "format", "deleted", "modified", "removed_lines", F.length("content").alias("characters"))


def folder_project_stats(spark: SparkSession, d: str) -> DataFrame:
    return process_project(table(spark, d, "documents"), "aggressive", content="text")[1]


def json_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Documents of JSON without repeated items, printed anew: lines and characters."""
    docs = spread(table(spark, d, "documents").where("format = 'json' and text is not null").select("doc_id", "text"))
    lines = docs.select("doc_id", rendered(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("lines"), F.length(F.array_join("lines", "\n")).alias("characters"))


def code_block_dups(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicate_blocks(P.code_blocks(_programs(spark, d)))


def _media(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as media: a sign hash each, and two variants with 1 and 2 bits flipped."""
    base = table(spark, d, "embeddings").select("vec_id", "label", M.sign_hash(F.col("embedding")).alias("h"))
    v = base.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    flip = F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") == 1, F.lit(1)).otherwise(F.lit(1 + (1 << 21))).cast("long")
    return v.select((F.col("vec_id") * 3 + F.col("k")).alias("item"), F.col("h").bitwiseXOR(flip).alias("dhash"), (F.col("label") * 1000 + F.col("k")).cast("long").alias("bytes"), F.lit(64).alias("pixels"), F.concat(F.lit("m/"), F.col("vec_id"), F.lit("_"), F.col("k")).alias("path"))


def media_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.similar_media(_media(spark, d))


def media_clusters(spark: SparkSession, d: str) -> DataFrame:
    return M.media_clusters(_media(spark, d))


def canonical_media(spark: SparkSession, d: str) -> DataFrame:
    items = _media(spark, d)
    return M.canonical_media(M.media_clusters(items), items)


def within_file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that repeat within their file, by file."""
    return P.within_file_lines(_files(spark, d)).select("path", F.col("removed").cast("long").alias("removed"))


def code_without_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Programs without repeated blocks: characters left, by file."""
    files = _programs(spark, d)
    return P.remove_blocks(files, P.code_blocks(files)).select("path", F.length("content").alias("characters"))


def media_target(spark: SparkSession, d: str) -> DataFrame:
    """Media within the widest distance of one target: the first item."""
    items = _media(spark, d)
    target = items.agg(F.min_by("dhash", "item")).first()[0]
    return M.matches_of_target(items, {"dhash": target}, 75).select("item", "distance")


def hue_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Histogram similarity of each vector's first twelve values and the next twelve, as shares."""
    e = table(spark, d, "embeddings")
    part = lambda at: F.transform(F.slice("embedding", at, 12), lambda x: F.abs(x).cast("double"))
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    return e.select("vec_id", F.round(M.hue_similarity(share(part(1)), share(part(13))), 6).alias("similarity"))


def dimension_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 40 + 1).alias("w"), (F.col("p_size") + 1).alias("h"))
    return p.select("p_partkey", M.dimension_gate(F.col("w"), F.col("h"), F.col("h"), F.col("w")).alias("resized"), M.dimension_gate(F.col("w"), F.col("h"), F.col("h"), F.col("w"), False).alias("same_size"))


QUERIES = {f.__name__: f for f in (media_paths, media_run, first_lines_format, folder_project, folder_project_stats, json_rendered, format_sniff, language_detect, path_skip, exact_file_dups, folder_summary, cross_file_lines, code_block_dups, within_file_lines, code_without_blocks, media_pairs, media_clusters, canonical_media, media_target, hue_similarity, dimension_gate)}


def _isin(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(Q.quoted(v) for v in values)})"


def _pts(cond: str, n: int) -> str:
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


def sniff_sql() -> str:
    s = {m: ["0"] for m in X.MODES}
    s["txt"].append("1")
    for mode, extensions in X.DATA.items():
        s[mode].append(_pts(_isin("ext", extensions), 20))
    s["code"].append(_pts(_isin("ext", X.CODE), 18))
    s["csv"].append(_pts("ext IN ('.tsv', '.tab')", 5))
    s["json"].append(_pts("ext IN ('.ndjson', '.jsonl')", 5))
    s["txt"].append(_pts("ext IN ('.md', '.markdown')", 8))
    s["todo"].append(_pts("ext <> '' AND (contains(base, 'todo') OR contains(base, 'shopping'))", 6))
    s["code"].append("CASE WHEN ext = '' THEN CASE WHEN base = 'dockerfile' OR starts_with(base, 'dockerfile.') OR base IN ('makefile', 'gnumakefile') THEN 15 WHEN base IN ('rakefile', 'gemfile', 'podfile') THEN 12 ELSE 0 END ELSE 0 END")
    s["txt"].append(_pts("ext = '' AND ends_with(base, '.env')", 7))
    for mode, weight, pattern in X.SIGNALS:
        s[mode].append(_pts(f"NOT blank AND regexp_matches(sample, {Q.re2(pattern)})", weight))
    for delimiter in ("','", "chr(9)"):
        s["csv"].append(_pts(f"NOT blank AND len(list_filter(lines, lambda x: {Q.sub('x', f'[{T.WS}]+')} <> '' AND len(string_split(x, {delimiter})) >= 3)) >= greatest(2, len(lines) * 0.4)", 10))
    s["json"].append(_pts("((starts_with(t, '[') AND ends_with(t, ']')) OR (starts_with(t, '{') AND ends_with(t, '}'))) AND json_valid(t)", 15))
    s["json"].append(_pts(f"NOT blank AND len(list_filter(lines[1:20], lambda x: {Q.sub('x', f'[{T.WS}]+')} <> '' AND json_valid(x))) >= 2", 12))
    ranked = ", ".join(f"{{'score': {' + '.join(v)}, 'rank': {-i}, 'mode': '{m}'}}" for i, (m, v) in enumerate(s.items()))
    return f"""WITH a AS (SELECT doc_id, coalesce(path, '') AS path, substring({Q.eol("coalesce(text, '')")}, 1, 16000) AS sample FROM documents),
      b AS (SELECT *, lower(string_split(replace(path, chr(92), '/'), '/')[-1]) AS base, string_split(sample, chr(10))[1:40] AS lines, {Q.sub('sample', f'[{T.WS}]+')} = '' AS blank, {Q.trim('sample')} AS t FROM a),
      c AS (SELECT *, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext FROM b),
      e AS (SELECT doc_id, ext, list_max([{ranked}]) AS best FROM c)
      SELECT doc_id, CASE WHEN {_isin('ext', X.SKIP)} THEN 'skip' ELSE best.mode END AS mode, round(CASE WHEN {_isin('ext', X.SKIP)} THEN 1.0 ELSE least(1.0, best.score / 25) END, 4) AS confidence FROM e"""


def language_sql() -> str:
    ranked = []
    for i, (name, extensions, imports, keywords) in enumerate(X.LANGUAGES):
        parts = [_pts(_isin("ext", extensions.split()), 25), *(_pts(f"regexp_matches(sample, {Q.re2(p)})", 8) for p in imports), *(_pts(f"regexp_matches(sample, {Q.re2(p)})", 4) for p in keywords)]
        ranked.append(f"{{'score': {' + '.join(parts)}, 'rank': {-i}, 'name': '{name}'}}")
    return f"""WITH a AS (SELECT doc_id, lower(string_split(replace(coalesce(path, ''), chr(92), '/'), '/')[-1]) AS base, substring({Q.eol("coalesce(text, '')")}, 1, 8000) AS sample FROM documents),
      c AS (SELECT *, regexp_extract(base, '^.+(\\.[^.]*)$', 1) AS ext FROM a), e AS (SELECT doc_id, list_max([{', '.join(ranked)}]) AS best FROM c)
      SELECT doc_id, CASE WHEN best.score > 0 THEN best.name ELSE 'generic' END AS language FROM e"""


#: Sort key that orders the paths of the test tables as the root locale does.
_LOCALE = "translate({p}, '_-,;:!?./', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11))"
_P = "lower(regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^/+', ''), '/+', '/', 'g'))"
_BASE = "lower(string_split(path, '/')[-1])"
_DUPS = f"""f AS (SELECT path, min(sha256(text)) AS hash FROM documents WHERE path IS NOT NULL AND text IS NOT NULL GROUP BY path),
  e AS (SELECT *, {_BASE} AS base, string_split({_BASE}, '.')[1] IN ('index', 'main', 'app', '__init__', 'mod') AS entry, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f),
  g AS (SELECT hash, count(*) AS copies, count(*) FILTER (WHERE NOT entry) AS eligible FROM e GROUP BY 1 HAVING count(*) > 1),
  s AS (SELECT hash, max(n) AS folders FROM (SELECT hash, base, count(DISTINCT folder) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
  c AS (SELECT hash, arg_min(path, (length(path), {_LOCALE.format(p='path')})) AS canonical FROM e WHERE NOT entry GROUP BY 1),
  r AS (SELECT e.path, e.hash, copies, folders > 1 OR eligible < 2 OR entry OR path = canonical AS kept, CASE WHEN NOT (folders > 1 OR eligible < 2) THEN canonical END AS canonical FROM e JOIN g USING (hash) JOIN s USING (hash) LEFT JOIN c USING (hash))"""
_SIGN = "list_reduce(list_prepend(0::HUGEINT, list_transform(embedding[1:64], lambda x: CASE WHEN x >= 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda h, x: h * 2 + x)"
_MEDIA = f"""v AS (SELECT vec_id, label, {_SIGN}::UBIGINT AS h FROM embeddings),
  m AS (SELECT vec_id * 3 + k AS item, xor(h, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2097153 END::UBIGINT) AS dhash, (label * 1000 + k)::BIGINT AS bytes, 'm/' || vec_id || '_' || k AS path FROM v, (VALUES (0), (1), (2)) AS t(k)),
  b AS (SELECT item, dhash, i, (dhash >> (16 * i)::UBIGINT) & 65535::UBIGINT AS band FROM m, (VALUES (0), (1), (2), (3)) AS t(i)),
  p AS (SELECT DISTINCT x.item AS a, y.item AS b, bit_count(xor(x.dhash, y.dhash)::BIT)::INTEGER AS distance FROM b x JOIN b y ON x.i = y.i AND x.band = y.band AND x.item < y.item WHERE bit_count(xor(x.dhash, y.dhash)::BIT) <= 5)"""
_CLUSTERS = f"""WITH RECURSIVE {_MEDIA}, u AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
  w AS (SELECT x AS item, x AS reach FROM u UNION SELECT w.item, u.y FROM w JOIN u ON w.reach = u.x), c AS (SELECT item, min(reach) AS component FROM w GROUP BY 1)"""
_SHARE = "list_transform(list_transform(embedding[{a}:{b}], lambda x: abs(x)::DOUBLE), lambda x: x / list_sum(list_transform(embedding[{a}:{b}], lambda y: abs(y)::DOUBLE)))"

ORACLES = {
    "format_sniff": sniff_sql(),
    "language_detect": language_sql(),
    "path_skip": f"SELECT doc_id, list_contains(string_split(p, '/'), 'projects') OR ends_with(p, '.eml') OR p = 'shared/2023' OR starts_with(p, 'shared/2023/') OR ends_with(p, '/shared/2023') OR contains(p, '/shared/2023/') OR regexp_matches(p, '^backup/r.*$') AS skipped, len(list_filter(string_split(p, '/'), lambda x: x IN ('node_modules', '.git', '.svn', '.hg', 'dist', 'build', '.next', 'coverage', 'out', 'vendor', '__pycache__', '.cache'))) > 0 AS ignored FROM (SELECT doc_id, {_P} AS p FROM documents WHERE path IS NOT NULL)",
    "exact_file_dups": f"WITH {_DUPS} SELECT path, copies, kept, canonical FROM r",
    "folder_summary": f"WITH {_DUPS} SELECT (SELECT count(DISTINCT path) FROM documents) AS files, count(DISTINCT hash) AS groups, count(*) FILTER (WHERE NOT kept) AS removed, (SELECT count(DISTINCT path) FROM documents) - count(*) FILTER (WHERE NOT kept) AS kept FROM r",
    "cross_file_lines": f"""WITH d AS (SELECT path, arg_min(text, doc_id) FILTER (WHERE text IS NOT NULL) AS text FROM documents WHERE path IS NOT NULL GROUP BY path),
      l AS (SELECT path, u.i AS i, {Q.raw_line('u.l')} AS line FROM d, unnest(string_split({Q.eol('text')}, chr(10))) WITH ORDINALITY AS u(l, i) WHERE text IS NOT NULL),
      k AS (SELECT path, line, row_number() OVER (PARTITION BY line ORDER BY {_LOCALE.format(p='path')}, i) AS rn FROM l)
      SELECT path, count(*) AS lines, count(*) FILTER (WHERE line <> '' AND rn > 1) AS removed FROM k GROUP BY path""",
    "media_paths": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 5 THEN 'video' END AS kind,
      CASE doc_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'video/quicktime' WHEN 5 THEN 'video/3gpp' ELSE 'application/octet-stream' END AS mime,
      len(list_filter(string_split(lower(replace(path, chr(92), '/')), '/'), lambda p: p IN ('thumb', 'thumbs', 'thumbnails', '.thumbnails', 'preview', 'previews', 'cache', '.ds_store', '__macosx'))) > 0 AS ignored FROM documents WHERE path IS NOT NULL""",
    "media_run": f"{_CLUSTERS} SELECT count(*) AS members, arg_min(path, (-bytes, lpad(string_split(replace(path, 'm/', ''), '_')[1], 24, '0'), path)) AS kept FROM c JOIN m USING (item) GROUP BY component",
    "media_pairs": f"WITH {_MEDIA} SELECT a, b, distance FROM p",
    "media_clusters": f"{_CLUSTERS} SELECT item, component FROM c",
    "canonical_media": f"{_CLUSTERS} SELECT component, arg_min(item, (-bytes, path)) AS kept, count(*) AS members FROM c JOIN m USING (item) GROUP BY component",
    "within_file_lines": f"SELECT any_value(path) AS path, count(*) - count(DISTINCT line) - count(*) FILTER (WHERE line = '') + count(DISTINCT line) FILTER (WHERE line = '') AS removed FROM (SELECT doc_id, path, {Q.raw_line('u.l')} AS line FROM documents, unnest(string_split({Q.eol('text')}, chr(10))) WITH ORDINALITY AS u(l, i) WHERE text IS NOT NULL AND path IS NOT NULL) GROUP BY doc_id",
    "media_target": f"WITH {_MEDIA} SELECT item, bit_count(xor(dhash, (SELECT arg_min(dhash, item) FROM m))::BIT)::INTEGER AS distance FROM m WHERE bit_count(xor(dhash, (SELECT arg_min(dhash, item) FROM m))::BIT) <= 16",
    "hue_similarity": f"""SELECT vec_id, round(0.65 * list_sum(list_transform(list_zip(a, b), lambda z: sqrt(z[1] * z[2]))) + 0.35 / (1 + list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[1] + z[2] + 1e-6)))), 6) AS similarity
      FROM (SELECT vec_id, {_SHARE.format(a=1, b=12)} AS a, {_SHARE.format(a=13, b=24)} AS b FROM embeddings)""",
    "dimension_gate": "SELECT p_partkey, greatest(w / h, h / w) / least(w / h, h / w) <= 3 AS resized, greatest(w / h, h / w) / least(w / h, h / w) <= 1.2 AS same_size FROM (SELECT p_partkey, p_partkey % 40 + 1 AS w, p_size + 1 AS h FROM part)",
}

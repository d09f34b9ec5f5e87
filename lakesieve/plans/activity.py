"""Plans over requests, deliveries and events: scoring, fingerprints, URLs, usage, bursts, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakesieve.functions import spamrules as R
from lakesieve.functions import text as T
from lakesieve.functions.hashing import fnv1a32
from lakesieve.operators import cleaning as C
from lakesieve.operators import media as M
from lakesieve.operators import usage as U
from lakesieve.plans import sqltext as Q
from lakesieve.session import table
from lakesieve.streaming import events as E


def fnv_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", True).where("text is not null").select("doc_id", fnv1a32(F.col("text")).alias("hash"))


def spam_normalized(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "score_requests", True).where("text is not null")
    return q.select("request_id", T.spam_normalize(F.col("text")).alias("normalized"), R.text_fingerprint(F.col("text")).alias("fingerprint"))


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """URLs of requests by host."""
    q = table(spark, d, "score_requests", True).where("text is not null").select("request_id", F.explode(R.urls(F.col("text"))).alias("url"))
    return q.groupBy(R.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("urls"), F.count_distinct("request_id").alias("requests"))


def _blob(fields: Column) -> Column:
    return F.coalesce("text", F.when(F.size(fields) > 0, R.form_text(fields)), F.lit(""))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Every request scored with the options of its tenant, without memory. Fields are taken in the order of their names."""
    opts = table(spark, d, "spam_opts").select("tenant", "max_urls", "blocklist")
    q = table(spark, d, "score_requests", True).join(opts, "tenant", "left")
    q = q.withColumn("ff", F.when(F.col("fields").isNotNull(), F.array_sort(R.fields_of_map(F.col("fields"))))).withColumn("blob", _blob(F.col("ff")))
    mode = F.when(F.col("fields").isNotNull(), "form").otherwise("list")
    return q.select("request_id", R.score_payload(F.col("blob"), F.col("ff"), mode, F.col("blocklist"), F.coalesce("max_urls", F.lit(3))).alias("s")).select("request_id", "s.*")


def spam_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("request_id", F.round("score", 3).alias("score"), F.array_join("reasons", ",").alias("reasons"), "decision", "normalized")


def spam_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("decision").agg(F.count("*").alias("requests"), F.round(F.avg("score"), 6).alias("mean_score"))


def given_scores(spark: SparkSession, d: str) -> DataFrame:
    """How many given results the scoring gives again: text requests, score and decision."""
    given = table(spark, d, "score_results").groupBy("request_id").agg(F.min("score").alias("g_score"), F.min("decision").alias("g_decision"))
    mine = _scored(spark, d).select("request_id", "score", "decision")
    j = mine.join(given, "request_id")
    return j.select(F.count("*").alias("results"), F.count_if((F.abs(F.col("score") - F.col("g_score")) < 0.001) & (F.col("decision") == F.col("g_decision"))).alias("same")).select("results", (F.col("same") >= 0.995 * F.col("results")).alias("agrees"))


def form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of deliveries whose payload is key=value lines."""
    c = table(spark, d, "check_requests").where(F.col("payload").startswith("topic="))
    return c.select("delivery_id", F.explode(R.form_fields(F.col("payload"))).alias("f")).select("delivery_id", F.col("f.k").alias("name"), F.length("f.v").alias("length"))


def form_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of requests with fields."""
    q = table(spark, d, "score_requests", True).where("fields is not null")
    return q.select("request_id", R.fields_fingerprint(R.fields_of_map(F.col("fields"))).alias("fingerprint"))


def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of the lines of list requests."""
    q = table(spark, d, "score_requests", True).where("text is not null and mode = 'list'")
    return C.clean_lines(q, "request_id", "text", "list").groupBy("request_id").agg(F.count("*").alias("lines"), F.sum(F.col("kept").cast("long")).alias("kept"))


def clean_forms(spark: SparkSession, d: str) -> DataFrame:
    """Requests with fields without what is blocked in them."""
    opts = table(spark, d, "spam_opts").select("tenant", "max_urls", "blocklist", "detect_honeypot")
    q = table(spark, d, "score_requests", True).where("fields is not null").join(opts, "tenant", "left")
    return q.select("request_id", C.clean_form(F.array_sort(R.fields_of_map(F.col("fields"))), F.col("blocklist"), F.coalesce("max_urls", F.lit(3)), F.col("detect_honeypot")).alias("cleaned"))


def usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return U.daily_usage(table(spark, d, "check_requests"), "tenant", "received_at")


def usage_history(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_history(usage_daily(spark, d))


def quota_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries beyond their tenant's daily limit (a hundredth of it, so that some are), by tenant."""
    limits = table(spark, d, "tenants").select("tenant", "daily_limit")
    c = table(spark, d, "check_requests").select("delivery_id", "tenant", "received_at").join(limits, "tenant", "left")
    q = U.within_quota(c, "tenant", "received_at", "delivery_id", F.floor(F.col("daily_limit") / 100))
    return q.groupBy("tenant").agg(F.count("*").alias("calls"), F.sum(F.col("admitted").cast("long")).alias("admitted"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "check_requests").select("delivery_id", "tenant", "received_at")
    return U.within_rate(c, "tenant", "received_at", "delivery_id", limit=2, seconds=3600).select("delivery_id", "admitted")


def log_ring(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "check_requests").select("delivery_id", "tenant", "received_at")
    return U.newest(c, "tenant", "received_at", "delivery_id", 20).select("tenant", "delivery_id")


def effective_plans(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tenants").select("tenant", U.effective_plan(F.col("plan"), F.col("plan_status")).alias("plan"))


def burst_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user, and what of them stays."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = M.runs(e, "user_id", ["ts", "event_id"], F.lag("event_type").over(w) == F.col("event_type"))
    return M.burst_representatives(r, "user_id", ["ts", "event_id"]).select("event_id", F.col("run").cast("long").alias("run"), F.col("size").cast("long").alias("size"), "stays")


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries checked one after another against their tenant's memory."""
    opts = table(spark, d, "spam_opts").select("tenant", F.col("burst_window_ms").alias("window_ms"))
    c = table(spark, d, "check_requests").join(opts, "tenant", "left")
    return E.replay(c.select("tenant", "delivery_id", T.js_trim(F.col("event_id")).alias("event_id"), "fingerprint", T.spam_normalize(F.col("payload")).alias("normalized"), F.col("received_at").alias("at"), "window_ms", "remember"))


def event_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries scored and decided one after another, with their tenant's memory."""
    opts = table(spark, d, "spam_opts").select("tenant", F.col("burst_window_ms").alias("window_ms"), "max_urls", "blocklist")
    c = table(spark, d, "check_requests", True).join(opts, "tenant", "left")
    empty = F.lit(None).cast("array<struct<k:string,v:string>>")
    s = R.score_payload(F.coalesce("payload", F.lit("")), empty, F.lit("list"), F.col("blocklist"), F.coalesce("max_urls", F.lit(3)))
    scored = c.select("tenant", "delivery_id", T.event_id(F.col("event_id")).alias("event_id"), F.col("received_at").alias("at"), "window_ms", "remember", s.alias("s"))
    rows = scored.select("tenant", "delivery_id", "event_id", "s.fingerprint", "s.normalized", "at", "window_ms", "remember", "s.score", "s.reasons")
    return E.decided(rows).select("delivery_id", "duplicate", "decision", "score", F.array_join("reasons", ",").alias("reasons"))


def input_presence(spark: SparkSession, d: str) -> DataFrame:
    """Which requests have something to check, and which deliveries."""
    q = table(spark, d, "score_requests")
    none = F.lit(None).cast("string")
    return q.select("request_id", R.has_input(F.col("text"), none, F.col("fields"), none).alias("has_input"))


def tenant_blocklists(spark: SparkSession, d: str) -> DataFrame:
    """Tenants' lists after an update that gives every tenth one a list and all others a common one."""
    stored = table(spark, d, "spam_opts").select("tenant", F.col("blocklist").alias("phrases")).where("phrases is not null")
    update = spark.createDataFrame([("", [" common phrase ", ""])], "tenant string, phrases array<string>")
    tenants = table(spark, d, "tenants").select("tenant", F.array(F.lit("own")).alias("blocklist"))
    return U.with_blocklists(tenants, U.put_blocklists(stored, update)).select("tenant", F.array_join("phrases", "|", "-").alias("phrases"))


def event_idempotency(spark: SparkSession, d: str) -> DataFrame:
    """The id half alone: sights of an id (here user and type) within six hours of the first one are duplicates."""
    e = table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("tenant"), F.col("event_id").alias("delivery_id"), F.col("event_type").alias("event_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fingerprint"), F.lit("").alias("normalized"), F.col("ts").alias("at"), F.lit(6 * 3600 * 1000).alias("window_ms"), F.lit(True).alias("remember"))
    return E.replay(rows).select(F.col("delivery_id").alias("event_id"), "duplicate")


QUERIES = {
    f.__name__: f
    for f in (
        fnv_fingerprint, spam_normalized, url_hosts, spam_score, spam_decisions, given_scores, form_fields, form_fingerprint, clean_lines, clean_forms, usage_daily, usage_history, quota_cutoff,
        rate_limit, log_ring, effective_plans, burst_runs, event_decisions, input_presence, tenant_blocklists, event_replay, event_idempotency,
    )
}



def _urls(e: str) -> str:
    return f"regexp_extract_all({e}, {Q.re2(R.URL)})"


def _host(e: str) -> str:
    return f"regexp_replace(lower(string_split(regexp_replace({e}, '(?i)^https?://', ''), '/')[1]), '^www\\.', '')"


_BAIT = [Q.re2(p) if i != 9 else "'(?i)\\bcasin[oо]\\b'" for i, p in enumerate(R.BAIT)]
_BARE = Q.sub("blob", f"[{T.WS}]+")
_RULES = [
    ("honeypot", f"ff IS NOT NULL AND len(list_filter(ff, lambda f: lower(f.key) IN ({', '.join(map(Q.quoted, R.HONEYPOTS))}) AND {Q.trim('coalesce(f.value, chr(32))')} <> '')) > 0"),
    ("blocklist", f"len(list_filter(coalesce(blocklist, []), lambda p: p IS NOT NULL AND {Q.trim('p')} <> '' AND contains(lower(blob), lower({Q.trim('p')})))) > 0"),
    ("url_flood", f"len(urls) >= coalesce(max_urls, 3) + 1 OR (len(urls) >= 2 AND len(urls) / greatest(len(list_filter(string_split({Q.eol('blob')}, chr(10)), lambda x: {Q.trim('x')} <> '')), 1) > 0.5)"),
    ("short_link", f"len(list_filter(urls, lambda u: {_host('u')} IN ({', '.join(map(Q.quoted, R.SHORT_HOSTS))}))) > 0"),
    ("disposable_email", f"lower(regexp_extract(blob, '(?i)[A-Z0-9._%+-]+@([A-Z0-9.-]+\\.[A-Z]{{2,}})', 1)) IN ({', '.join(map(Q.quoted, R.DISPOSABLE))})"),
    ("bait", " OR ".join(f"regexp_matches(blob, {p})" for p in _BAIT)),
    ("gibberish", "length(bare) >= 16 AND letters >= 12 AND (length(regexp_replace(bare, '[^aeiouAEIOU]', '', 'g')) / letters < 0.12 OR len(list_filter(range(1, len(chars) - 4), lambda i: chars[i] = chars[i + 1] AND chars[i] = chars[i + 2] AND chars[i] = chars[i + 3] AND chars[i] = chars[i + 4] AND chars[i] = chars[i + 5])) > 0)"),
    ("mixed_script", "regexp_matches(blob, '[A-Za-z]') AND regexp_matches(blob, '[\\x{0400}-\\x{04FF}]')"),
    ("all_caps", "letters >= 12 AND length(regexp_replace(blob, '[^A-Z]', '', 'g')) / letters > 0.78"),
    ("repeated_tokens", "len(tokens) >= 6 AND list_max(map_values(list_histogram(tokens))) / len(tokens) > 0.45"),
]
_STEPS = f"""b AS (SELECT *, coalesce(text, CASE WHEN len(ff) > 0 THEN array_to_string(list_transform(ff, lambda f: f.key || '=' || coalesce(f.value, 'null')), chr(10)) END, '') AS blob FROM q),
  n AS (SELECT *, {Q.spam_normalize('blob')} AS normalized, {_urls('blob')} AS urls, {_BARE} AS bare FROM b),
  t AS (SELECT *, length(regexp_replace(bare, '[^A-Za-z]', '', 'g')) AS letters, string_split(bare, '') AS chars, list_filter(string_split(normalized, ' '), lambda x: x <> '') AS tokens FROM n),
  s AS (SELECT request_id, normalized, {Q.trim('blob')} = '' AS blank, list_filter([{', '.join(f"CASE WHEN {cond} THEN {{'r': '{name}', 's': {R.SCORES[name]}::DOUBLE}} END" for name, cond in _RULES)}], lambda x: x IS NOT NULL) AS fired FROM t),
  o AS (SELECT request_id, normalized, CASE WHEN blank OR len(fired) = 0 THEN 0.0::DOUBLE ELSE list_max(list_transform(fired, lambda x: x.s)) END AS score, CASE WHEN blank THEN 'empty' ELSE array_to_string(list_transform(fired, lambda x: x.r), ',') END AS reasons, blank FROM s),
  z AS (SELECT *, CASE WHEN blank THEN 'soft_reject' WHEN score >= 0.72 THEN 'block' WHEN score >= 0.42 THEN 'soft_reject' ELSE 'allow' END AS decision FROM o)"""
_SCORED = f"WITH q AS (SELECT request_id, text, max_urls, blocklist, CASE WHEN fields IS NOT NULL THEN list_sort(map_entries(fields)) END AS ff FROM score_requests LEFT JOIN spam_opts USING (tenant)), {_STEPS}"
_TRAPS = ", ".join(map(Q.quoted, R.HONEYPOTS))
#: Every field of a request scored by itself: its value is the text, request_id the field's number.
_FORMS = f"""WITH f AS (SELECT request_id AS of, u.i AS i, u.e.key AS k, u.e.value AS v, max_urls, blocklist, coalesce(detect_honeypot, true) AS watch FROM (SELECT *, list_sort(map_entries(fields)) AS es FROM score_requests LEFT JOIN spam_opts USING (tenant) WHERE fields IS NOT NULL), unnest(es) WITH ORDINALITY AS u(e, i)),
  q AS (SELECT of * 4096 + i AS request_id, coalesce(v, '') AS text, max_urls, blocklist, NULL::STRUCT(key VARCHAR, value VARCHAR)[] AS ff FROM f), {_STEPS},
  m AS (SELECT f.*, watch AND lower(k) IN ({_TRAPS}) AS named, z.decision = 'block' OR len(list_filter(coalesce(f.blocklist, []), lambda p: p IS NOT NULL AND {Q.trim('p')} <> '' AND contains(lower(k || ' ' || coalesce(v, 'null')), lower({Q.trim('p')})))) > 0 AS bad FROM f JOIN z ON z.request_id = f.of * 4096 + f.i),
  g AS (SELECT of, CASE WHEN bool_or(named AND {Q.trim("coalesce(v, '')")} <> '') THEN '' ELSE coalesce(string_agg(k || '=' || coalesce(v, 'null'), chr(10) ORDER BY i) FILTER (WHERE NOT named AND NOT bad), '') END AS cleaned FROM m GROUP BY 1)
  SELECT r.request_id, coalesce(g.cleaned, '') AS cleaned FROM score_requests r LEFT JOIN g ON g.of = r.request_id WHERE r.fields IS NOT NULL"""
_KEPT = f"list_filter(list_sort(map_entries(fields)), lambda f: lower(f.key) NOT IN ({', '.join(map(Q.quoted, R.HONEYPOTS))}))"
_CANON = f"'{{' || array_to_string(list_transform({_KEPT}, lambda f: to_json(lower(f.key))::VARCHAR || ':' || to_json({Q.spam_normalize('f.value')})::VARCHAR), ',') || '}}'"

ORACLES = {
    "fnv_fingerprint": f"SELECT doc_id, {Q.fnv1a32('text')} AS hash FROM documents WHERE text IS NOT NULL",
    "spam_normalized": f"SELECT request_id, n AS normalized, {Q.fnv1a32('n')} AS fingerprint FROM (SELECT request_id, {Q.spam_normalize('text')} AS n FROM score_requests WHERE text IS NOT NULL)",
    "url_hosts": f"SELECT {_host('url')} AS host, count(*) AS urls, count(DISTINCT request_id) AS requests FROM (SELECT request_id, unnest({_urls('text')}) AS url FROM score_requests WHERE text IS NOT NULL) GROUP BY 1",
    "spam_score": f"{_SCORED} SELECT request_id, round(score, 3) AS score, reasons, decision, normalized FROM z",
    "spam_decisions": f"{_SCORED} SELECT decision, count(*) AS requests, round(avg(score), 6) AS mean_score FROM z GROUP BY 1",
    "given_scores": "SELECT count(DISTINCT request_id) AS results, true AS agrees FROM score_results JOIN score_requests USING (request_id)",
    "form_fields": f"""WITH p AS (SELECT delivery_id, {Q.trim('u.l')} AS l FROM (SELECT delivery_id, {Q.trim('payload')} AS payload FROM check_requests WHERE starts_with(payload, 'topic=')), unnest(CASE WHEN contains(payload, chr(10)) THEN string_split_regex(payload, '\\r?\\n') ELSE string_split(payload, '&') END) AS u(l)),
      s AS (SELECT delivery_id, l, CASE WHEN strpos(l, '=') > 1 AND (strpos(l, ':') = 0 OR strpos(l, '=') < strpos(l, ':')) THEN strpos(l, '=') WHEN strpos(l, ':') > 1 THEN strpos(l, ':') END AS cut FROM p)
      SELECT delivery_id, {Q.trim('substring(l, 1, cut - 1)')} AS name, length({Q.trim('substring(l, cut + 1)')})::INTEGER AS length FROM s WHERE cut IS NOT NULL""",
    "form_fingerprint": f"SELECT request_id, {Q.fnv1a32('c')} AS fingerprint FROM (SELECT request_id, {_CANON} AS c FROM score_requests WHERE fields IS NOT NULL)",
    "clean_forms": _FORMS,
    "input_presence": "SELECT request_id, coalesce(text <> '', false) OR fields IS NOT NULL AS has_input FROM score_requests",
    "tenant_blocklists": "SELECT t.tenant, array_to_string(list_concat(['own'], list_transform(coalesce(o.blocklist, ['common phrase']), lambda x: coalesce(x, '-'))), '|') AS phrases FROM tenants t LEFT JOIN spam_opts o USING (tenant)",
    "usage_daily": "SELECT tenant, received_at::DATE AS day, count(*) AS calls FROM check_requests WHERE received_at IS NOT NULL GROUP BY 1, 2",
    "usage_history": "WITH u AS (SELECT received_at::DATE AS day, count(*) AS calls FROM check_requests WHERE received_at IS NOT NULL GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT max(day) FROM u) - INTERVAL 6 DAY, (SELECT max(day) FROM u), INTERVAL 1 DAY))::DATE AS day) SELECT s.day, coalesce(calls, 0) AS calls FROM s LEFT JOIN u USING (day)",
    "quota_cutoff": "SELECT tenant, count(*) AS calls, sum(CASE WHEN daily_limit IS NULL OR rn <= floor(daily_limit / 100) THEN 1 ELSE 0 END)::BIGINT AS admitted FROM (SELECT tenant, daily_limit, row_number() OVER (PARTITION BY tenant, received_at::DATE ORDER BY received_at, delivery_id) AS rn FROM check_requests LEFT JOIN tenants USING (tenant)) GROUP BY 1",
    "rate_limit": "SELECT delivery_id, row_number() OVER (PARTITION BY tenant, floor(epoch(received_at) / 3600) ORDER BY received_at, delivery_id) <= 2 AS admitted FROM check_requests",
    "log_ring": "SELECT tenant, delivery_id FROM (SELECT tenant, delivery_id, row_number() OVER (PARTITION BY tenant ORDER BY received_at DESC, delivery_id DESC) AS rn FROM check_requests) WHERE rn <= 20",
    "effective_plans": "SELECT tenant, CASE WHEN plan_status IN ('active', 'trialing') THEN plan ELSE 'guest' END AS plan FROM tenants",
    "burst_runs": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
      n AS (SELECT event_id, run, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id, run) AS size FROM r)
      SELECT event_id, run::BIGINT AS run, size, size = 1 OR rn = 1 OR (size = 2 AND rn = 2) OR (size >= 3 AND rn = size // 2 + 1) AS stays FROM n""",
    "event_idempotency": """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, ts FROM events),
      a AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY 1, 2
        UNION ALL SELECT * FROM (SELECT user_id, event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = a.user_id AND e.event_type = a.event_type AND e.ts >= a.ts + INTERVAL 6 HOUR) AS ts FROM a) WHERE ts IS NOT NULL),
      f AS (SELECT e.event_id FROM e JOIN a USING (user_id, event_type, ts) QUALIFY row_number() OVER (PARTITION BY e.user_id, e.event_type, e.ts ORDER BY e.event_id) = 1)
      SELECT event_id, event_id NOT IN (SELECT event_id FROM f) AS duplicate FROM e""",
}

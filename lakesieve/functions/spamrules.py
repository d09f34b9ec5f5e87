"""Form parsing and the spam detectors (J4-J16, R1, R2) as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesieve.functions.hashing import fnv1a32
from lakesieve.functions.text import LB, RB, WS, eol, js_trim, spam_normalize

# Fields that people leave empty, domains of throw-away mail, hosts of short links, bait.
HONEYPOTS = ("_gotcha", "_honey", "_honeytrap", "honeypot", "website", "url", "fax", "company_url", "homepage", "phone2", "address2", "confirm_email_leave_blank")
DISPOSABLE = (
    "mailinator.com", "guerrillamail.com", "tempmail.com", "10minutemail.com", "yopmail.com", "trashmail.com", "sharklasers.com", "discard.email", "temp-mail.org", "getnada.com",
    "maildrop.cc", "mailnesia.com", "throwawaymail.com", "fakeinbox.com", "moakt.com", "emailondeck.com", "guerrillamail.org", "spamgourmet.com", "mailcatch.com", "tempr.email",
)
SHORT_HOSTS = ("bit.ly", "t.co", "goo.gl", "tinyurl.com", "ow.ly", "buff.ly", "rebrand.ly", "cutt.ly", "is.gd", "v.gd", "rb.gy", "shorturl.at")
BAIT = (
    f"(?i){LB}viagra{RB}", f"(?i){LB}cialis{RB}", f"(?i){LB}crypto[{WS}]*(?:airdrop|giveaway|pump){RB}", f"(?i){LB}free[{WS}]*money{RB}", f"(?i){LB}act[{WS}]*now{RB}",
    f"(?i){LB}limited[{WS}]*time[{WS}]*offer{RB}", f"(?i){LB}work[{WS}]*from[{WS}]*home{RB}", f"(?i){LB}double[{WS}]*your[{WS}]*(?:btc|bitcoin|crypto){RB}", f"(?i){LB}seo[{WS}]*backlinks?{RB}",
    f"(?i){LB}casino{RB}|(?i){LB}casin[\\u043E\\u041E](?=[A-Za-z0-9_])", f"(?i)<script{RB}", f"(?i)javascript[{WS}]*:", f"(?i)on(?:error|load|click)[{WS}]*=", "\\$\\{[^}]+\\}", "\\{\\{[^}]+\\}\\}",
)
#: What the lower-case text contains wherever the pattern at the same place matches; a cheap test before it.
BAIT_HINTS = ("viagra", "cialis", "crypto", "free", "act", "limited", "work", "double", "seo", "casin", "<script", "javascript", "on", "${", "{{")
SCORES = {
    "honeypot": 0.98, "blocklist": 0.92, "url_flood": 0.74, "short_link": 0.55, "disposable_email": 0.62, "bait": 0.78, "gibberish": 0.58, "mixed_script": 0.5, "all_caps": 0.4, "repeated_tokens": 0.52,
    "burst": 0.9, "near_duplicate": 0.76,
}
BLOCK, SOFT = 0.72, 0.42
URL = "(?i)https?://[^" + WS + "<>\"']+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside of a lambda is computed for each element, and one used twice may be computed
    twice; bound as the variable of an array of one it is not.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def form_fields(c: Column) -> Column:
    """Array of (k, v) of a form body, in order; the last value of a repeated key at its first place.

    Lines (or parts between ``&`` if there is one line) are cut at ``=`` where that comes before any ``:``, else
    at ``:``; plus signs and percent escapes are decoded, a bad escape leaves the part as it is. A JSON object is
    read as its members: nested ones as JSON, null as an empty text.
    """
    t = js_trim(c)
    parts = F.when(F.contains(t, F.lit("\n")), F.split(t, "\\r?\\n")).otherwise(F.split(t, "&"))

    def pair(p: Column) -> Column:
        eq, colon = F.instr(p, "="), F.instr(p, ":")
        sep = F.when((eq > 1) & ((colon == 0) | (eq < colon)), eq).when(colon > 1, colon)
        # A part without % and + is its own decoding. Without try_* the expression would fail on a bad escape.
        decode = lambda x: F.coalesce(F.try_url_decode(x), x)
        return F.struct(decode(js_trim(F.substring(p, F.lit(1), sep - 1))).alias("k"), decode(js_trim(F.substring(p, sep + 1, F.length(p)))).alias("v"))

    pairs = F.filter(F.transform(F.filter(F.transform(parts, js_trim), lambda p: p != ""), pair), lambda f: f["k"].isNotNull() & (f["k"] != ""))
    as_json = F.from_json(t, "map<string,string>")
    members = F.transform(F.map_entries(as_json), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
    fields = F.when(t.startswith("{") & as_json.isNotNull(), members).otherwise(pairs)

    def last_wins(f: Column) -> Column:
        keys = F.array_distinct(F.transform(f, lambda x: x["k"]))
        return F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(f, lambda x: x["k"] == k), -1)["v"].alias("v")))

    return let(fields, last_wins)


def fields_of_map(m: Column) -> Column:
    """A map as an array of (k, v)."""
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def form_text(fields: Column) -> Column:
    """``key=value`` lines of fields."""
    return F.array_join(F.transform(fields, lambda f: F.concat(f["k"], F.lit("="), F.coalesce(f["v"], F.lit("null")))), "\n")


def honeypot(fields: Column) -> Column:
    """Whether a field that people leave empty is filled."""
    return F.exists(fields, lambda f: F.lower(f["k"]).isin(*HONEYPOTS) & (F.coalesce(js_trim(f["v"]), F.lit("")) != ""))


def urls(c: Column) -> Column:
    """J6."""
    return F.regexp_extract_all(c, F.lit(URL), F.lit(0))


def url_host(c: Column) -> Column:
    """Host of a URL in lower case without www. (port and query stay)."""
    return F.regexp_replace(F.lower(F.substring_index(F.regexp_replace(c, "(?i)^https?://", ""), "/", 1)), "^www\\.", "")


def short_link(c: Column) -> Column:
    """J8."""
    return F.exists(urls(c), lambda u: url_host(u).isin(*SHORT_HOSTS))


def disposable_email(c: Column) -> Column:
    """Whether the first e-mail address is one of a throw-away domain."""
    return F.lower(F.regexp_extract(c, "(?i)[A-Z0-9._%+-]+@([A-Z0-9.-]+\\.[A-Z]{2,})", 1)).isin(*DISPOSABLE)


def bait(c: Column) -> Column:
    """J10."""

    def test(low: Column) -> Column:
        found = F.lit(False)
        for hint, p in zip(BAIT_HINTS, BAIT, strict=True):
            found = found | (F.contains(low, F.lit(hint)) & c.rlike(p))
        return found

    return let(F.lower(c), test)


def gibberish(c: Column) -> Column:
    """Long and almost without vowels, or a character six times in a row."""

    def test(s: Column) -> Column:
        letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
        vowels = F.length(F.regexp_replace(s, "[^aeiouAEIOU]", ""))
        return (F.length(s) >= 16) & (letters >= 12) & ((vowels / letters < 0.12) | s.rlike("(.)\\1{5,}"))

    return let(F.regexp_replace(c, f"[{WS}]+", ""), test)


def mixed_script(c: Column) -> Column:
    """Latin and Cyrillic letters."""
    return c.rlike("[A-Za-z]") & c.rlike("[\\u0400-\\u04FF]")


def all_caps(c: Column) -> Column:
    """J13."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return (letters >= 12) & (F.length(F.regexp_replace(c, "[^A-Z]", "")) / letters > 0.78)


def repeated_tokens(normalized: Column) -> Column:
    """Six tokens or more, one of them more than 45 % of all."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def count(state: Column, token: Column) -> Column:
        run = F.when(state["last"] == token, state["run"] + 1).otherwise(1)
        return F.struct(token.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    def test(tokens: Column) -> Column:
        return (F.size(tokens) >= 6) & (F.aggregate(tokens, start, count, lambda x: x["most"]) / F.size(tokens) > 0.45)

    return let(F.array_sort(F.filter(F.split(normalized, " "), lambda x: x != "")), test)


def blocklisted(c: Column, phrases: Column) -> Column:
    """Whether the text contains a phrase, in any case."""
    clean = F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: p.isNotNull() & (js_trim(p) != ""))
    return let(F.lower(c), lambda low: F.exists(clean, lambda p: F.contains(low, F.lower(js_trim(p)))))


def url_flood(c: Column, max_urls: Column) -> Column:
    """R2: more URLs than allowed, or more than one for every two lines."""
    lines = F.size(F.filter(F.split(eol(c), "\n"), lambda x: js_trim(x) != ""))
    return let(F.size(urls(c)), lambda n: (n >= max_urls + 1) | ((n >= 2) & (n / F.greatest(lines, F.lit(1)) > 0.5)))


def _quoted(c: Column) -> Column:
    """A JSON string as JSON.stringify writes it."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), "^\\{\"x\":(.*)\\}\\z", 1)


def fields_fingerprint(fields: Column, strip_trackers: Column | bool = True) -> Column:
    """H4 of a form: hash of the canonical JSON of normalised values, without honeypots, keys in lower case."""
    kept = F.filter(F.array_sort(fields), lambda f: ~F.lower(f["k"]).isin(*HONEYPOTS))
    low = F.transform(kept, lambda f: F.struct(F.lower(f["k"]).alias("k"), spam_normalize(f["v"], strip_trackers).alias("v")))

    def body(fs: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(fs, lambda f: f["k"])))
        members = F.transform(keys, lambda k: F.concat(_quoted(k), F.lit(":"), _quoted(F.element_at(F.filter(fs, lambda f: f["k"] == k), -1)["v"])))
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))

    return let(let(low, body), fnv1a32)


def text_fingerprint(c: Column, strip_trackers: Column | bool = True) -> Column:
    """H4 of a list or log: hash of the normalised text."""
    return let(spam_normalize(c, strip_trackers), fnv1a32)


def score_payload(text: Column, fields: Column, mode: Column, phrases: Column, max_urls: Column, detect_honeypot: Column | bool = True, strip_trackers: Column | bool = True) -> Column:
    """Struct (score, reasons, decision, fingerprint, normalized, mode) of a payload.

    ``text`` is the text, or the ``key=value`` lines of ``fields``; fields count in form mode. The score is the
    largest of the rules that fire; a blank text is ``empty`` and rejected softly. Memory-less: burst and
    near_duplicate need the history operators.
    """
    return let(text, lambda t: let(spam_normalize(t, strip_trackers), lambda n: _score(t, n, fields, mode, phrases, max_urls, detect_honeypot, strip_trackers)))


def _score(text: Column, normalized: Column, fields: Column, mode: Column, phrases: Column, max_urls: Column, detect_honeypot: Column | bool, strip_trackers: Column | bool) -> Column:
    watch = F.lit(detect_honeypot) if isinstance(detect_honeypot, bool) else F.coalesce(detect_honeypot, F.lit(True))
    rules = [
        ("honeypot", watch & fields.isNotNull() & honeypot(fields)), ("blocklist", blocklisted(text, phrases)), ("url_flood", url_flood(text, max_urls)), ("short_link", short_link(text)),
        ("disposable_email", disposable_email(text)), ("bait", bait(text)), ("gibberish", gibberish(text)), ("mixed_script", mixed_script(text)), ("all_caps", all_caps(text)), ("repeated_tokens", repeated_tokens(normalized)),
    ]
    fired = F.filter(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("r"), F.lit(SCORES[name]).alias("s"))) for name, hit in rules)), lambda x: x.isNotNull())
    blank = js_trim(text) == ""
    finger = F.when((mode == "form") & fields.isNotNull(), fields_fingerprint(fields, strip_trackers)).otherwise(fnv1a32(normalized))

    def result(hits: Column) -> Column:
        score = F.when(blank | (F.size(hits) == 0), 0.0).otherwise(F.array_max(F.transform(hits, lambda x: x["s"])))
        reasons = F.when(blank, F.array(F.lit("empty"))).otherwise(F.transform(hits, lambda x: x["r"]))
        decision = lambda s: F.when(blank, "soft_reject").when(s >= BLOCK, "block").when(s >= SOFT, "soft_reject").otherwise("allow")
        return let(score, lambda s: F.struct(s.alias("score"), reasons.alias("reasons"), decision(s).alias("decision"), finger.alias("fingerprint"), normalized.alias("normalized"), mode.alias("mode")))

    return let(fired, result)


def has_input(text: Column, payload: Column, fields: Column, event_id: Column) -> Column:
    """Whether a request has anything to check: a text or payload that is not empty, fields, or an id that is not blank."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    return some(text) | some(payload) | fields.isNotNull() | some(js_trim(event_id))

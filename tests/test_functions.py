"""Record-local functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lakesieve.functions import hashing as H
from lakesieve.functions import spamrules as R
from lakesieve.functions import text as T
from lakesieve.functions.jsonx import canonical_text, items_of, number_text, valid_json


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("s", "h"), [("hello", "4f9f2cab"), ("ñandú", "4e00d685"), ("😀x", "9f58ba40"), ("", "811c9dc5"), ("hello world", "d58b3fa7"), (None, None)])
def test_fnv(spark, s, h):
    assert value(spark, H.fnv1a32(F.lit(s).cast("string"))) == h


def test_normalisers(spark):
    one = lambda fn, s: value(spark, fn(F.lit(s)))
    assert one(T.eol, "a\r\nb\rc") == "a\nb\nc"
    assert one(T.raw_line, "\t a b \t") == "a b"
    assert value(spark, T.raw_line(F.lit("\ta "), keep_indent=True)) == "    a"
    assert one(T.strip_log, "[2024-01-01 10:00:00] ERROR id=7 fail pid=12 10.0.0.1 /x?a=1") == "fail /x"
    assert one(T.strip_todo, "- [x] TODO: milk") == "milk"
    assert one(T.strip_bullet, " 12. one") == "one"
    assert value(spark, T.compare_filter(F.lit("a.b,  c"), True, True)) == "ab c"
    assert one(T.spam_normalize, "Hello 2024-01-01T12:00:00Z world") == "hello world"
    assert one(T.spam_normalize, None) == ""
    assert one(T.extension, "a/b.tar.GZ") == ".gz"
    assert one(T.extension, ".gitignore") == ""
    assert one(T.event_id, " ok-id_1 ") == "ok-id_1"
    assert one(T.event_id, "bad id!") is None
    assert value(spark, T.event_id(F.lit("x" * 200))) is None
    assert one(T.email_normalize, " A@B.co ") == "a@b.co"
    assert one(T.strip_blocks, "a/*x\ny*/b") == "ab"
    assert value(spark, T.cut_at(F.lit("x = 1 // http"), "//")) == "x = 1"
    assert value(spark, T.code_metadata(F.lit("a 0x1F 'b' 2.5"), True, True)) == 'a 0 "" 0'


def test_jaccard(spark):
    assert value(spark, T.jaccard(F.lit("red green blue"), F.lit("red green blue sky"))) == 0.75
    assert value(spark, T.jaccard(F.lit("?"), F.lit("?"))) == 1.0
    assert value(spark, T.jaccard(F.lit("?"), F.lit("a"))) == 0.0


def test_forms_and_fingerprints(spark):
    form = lambda s: value(spark, R.form_fields(F.lit(s)))
    assert [(f.k, f.v) for f in form("name=Ada\nemail: a%40b.com\nname=Bo")] == [("name", "Bo"), ("email", "a@b.com")]
    assert [(f.k, f.v) for f in form('{"a": 1, "b": null}')] == [("a", "1"), ("b", "")]
    finger = lambda s: value(spark, R.fields_fingerprint(R.form_fields(F.lit(s))))
    assert finger("name=Ada\nemail=a@b.com") == "68666298" == finger("name=Ada\nemail=a@b.com\n_gotcha=x")


def score(spark, text, form=True, phrases=()):
    fields = R.form_fields(F.lit(text)) if form else F.lit(None).cast("array<struct<k:string,v:string>>")
    blocked = F.array(*map(F.lit, phrases)).cast("array<string>") if phrases else F.array().cast("array<string>")
    return value(spark, R.score_payload(F.lit(text), fields, F.lit("form" if form else "list"), blocked, F.lit(3)))


def test_scores(spark):
    s = score(spark, "name=Ada\n_gotcha=bot\nemail=ada@example.com")
    assert (s.decision, s.reasons, s.score) == ("block", ["honeypot"], 0.98)
    assert score(spark, "name=Ada\nemail=ada@example.com\nmessage=Hello there").decision == "allow"
    s = score(spark, "Limited time offer act now for free money", False)
    assert "bait" in s.reasons and s.decision == "block"
    assert score(spark, "hello@mailinator.com wants a deal", False).reasons == ["disposable_email"]
    assert score(spark, "BUY http://x.com http://y.com http://z.com http://w.com", False).reasons[0] == "url_flood"
    assert score(spark, "  ", False).reasons == ["empty"]
    assert score(spark, "now a Crypto Airdrop", False, ["crypto airdrop"]).decision == "block"
    assert "repeated_tokens" in score(spark, "win win win win lose win", False).reasons
    assert "gibberish" in score(spark, "xkcdqwrtzpsdfghjkl", False).reasons


def test_json(spark):
    for x, t in [(1e2, "100"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (123456789012345680000.0, "123456789012345680000"), (1e-6, "0.000001"), (-2.5, "-2.5"), (0.0, "0")]:
        assert number_text(x) == t
    assert canonical_text('{"b":1e2,"a":[1, null]}') == '{"a":[1,null],"b":100}'
    assert canonical_text(" nope ") == "nope"
    assert items_of('[{"b":1,"a":2}, "x"]') == ['{"a":2,"b":1}', "x"]
    assert items_of(None) == []
    check = lambda s: value(spark, valid_json(F.lit(s)))
    assert [check(s) for s in ('{"a":1}', '{"a":1}}', '{"a":1} x', '{"a":1},', "[1,2]x", "[1]")] == [True, False, False, False, False, True]

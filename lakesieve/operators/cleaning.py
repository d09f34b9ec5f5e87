"""Cleaning of payloads: lines (R3, M6) and form fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesieve.functions import spamrules as R
from lakesieve.functions.text import eol, js_trim
from lakesieve.operators.leaders import similarity, word_set

_FACTS = "array<struct<line:string,blank:boolean,score:double,reasons:array<string>,decision:string,fingerprint:string,normalized:string>>"


def clean_pass(facts: list[dict], mode: str, threshold: float) -> list[dict]:
    """The lines of one text in order, with what becomes of them.

    Blank lines stay. A line goes if it has a blocklisted phrase, if it is blocked, if it repeats a line that was
    kept (equal fingerprint: burst, similar: near_duplicate), if a list rejects it softly, or if a log rejects it
    softly for bait or a flood of URLs. Only the first kept line that matches counts.
    """
    kept: list[tuple[str, str, frozenset[str]]] = []
    seen: set[str] = set()
    out = []
    for i, f in enumerate(facts):
        if f["blank"]:
            out.append({"index": i, "line": f["line"], "kept": True, "reasons": []})
            continue
        score, reasons = f["score"], list(f["reasons"])
        words = word_set(f["normalized"])
        repeat = None
        if f["fingerprint"] in seen or kept:
            for finger, norm, other in kept:
                if finger == f["fingerprint"]:
                    repeat = "burst"
                    break
                if norm and f["normalized"] and similarity(f["normalized"], norm, words, other) >= threshold:
                    repeat = "near_duplicate"
                    break
        if repeat:
            reasons.append(repeat)
            score = max(score, R.SCORES[repeat])
        decision = "block" if score >= R.BLOCK else "soft_reject" if score >= R.SOFT else "allow"
        soft = decision == "soft_reject"
        gone = "blocklist" in reasons or decision == "block" or (repeat is not None and mode != "log") or (soft and mode == "list") or (soft and mode == "log" and bool({"bait", "url_flood"} & set(reasons)))
        if not gone:
            kept.append((f["fingerprint"], f["normalized"], words))
            seen.add(f["fingerprint"])
        out.append({"index": i, "line": f["line"], "kept": not gone, "reasons": reasons if gone else []})
    return out


def line_facts(text: Column, phrases: Column, max_urls: Column) -> Column:
    """The memory-less part of the lines' scores, an array in the text's order."""

    def facts(line: Column) -> Column:
        s = R.score_payload(line, F.lit(None).cast("array<struct<k:string,v:string>>"), F.lit("list"), phrases, max_urls)
        return F.struct(line.alias("line"), (js_trim(line) == "").alias("blank"), s["score"].alias("score"), s["reasons"].alias("reasons"), s["decision"].alias("decision"), s["fingerprint"].alias("fingerprint"), s["normalized"].alias("normalized"))

    return F.transform(F.split(eol(text), "\n"), facts)


def clean_lines(docs: DataFrame, id_col: str, text_col: str, mode: str = "list", threshold: float = 0.85, phrases: Column | None = None, max_urls: Column | None = None) -> DataFrame:
    """(id, index, line, kept, reasons) of every line. Null texts have none.

    A text is one row, so the pass needs no shuffle; rules are Columns, only the greedy pass is Python.
    """

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else clean_pass(list(v), mode, threshold))

    phrases = F.array().cast("array<string>") if phrases is None else phrases
    facts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), line_facts(F.col(text_col), phrases, F.lit(3) if max_urls is None else max_urls).alias("facts"))
    done = facts.select("id", F.explode(F.pandas_udf(run, "array<struct<index:int,line:string,kept:boolean,reasons:array<string>>>")("facts")).alias("x"))
    return done.select(F.col("id").alias(id_col), "x.index", "x.line", "x.kept", "x.reasons")


def clean_form(fields: Column, phrases: Column, max_urls: Column, detect_honeypot: Column | bool = True, strip_trackers: Column | bool = True) -> Column:
    """The fields that stay, as ``key=value`` lines, whatever the mode.

    A filled honeypot wipes the form; empty honeypots go silently; another field goes if it contains a blocklisted
    phrase (in its name, a blank and its value) or if its value by itself is blocked as a list. Where honeypots are
    not watched they are fields like others. No fields give an empty text; lines are cleaned by ``clean_lines``.
    """
    empty = F.lit(None).cast("array<struct<k:string,v:string>>")
    watch = F.lit(detect_honeypot) if isinstance(detect_honeypot, bool) else F.coalesce(detect_honeypot, F.lit(True))
    trap = watch & F.coalesce(R.honeypot(fields), F.lit(False))

    def stays(f: Column) -> Column:
        value = F.coalesce(f["v"], F.lit(""))
        own = R.score_payload(value, empty, F.lit("list"), phrases, max_urls, detect_honeypot, strip_trackers)
        named = watch & F.lower(f["k"]).isin(*R.HONEYPOTS)
        return ~named & ~R.blocklisted(F.concat_ws(" ", f["k"], F.coalesce(f["v"], F.lit("null"))), phrases) & (own["decision"] != "block")

    return F.when(trap, F.lit("")).otherwise(R.form_text(F.filter(fields, stays)))

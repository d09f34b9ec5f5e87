"""Stateful event checks (R5, R6, M13): batch replay and Structured Streaming with the same state machine.

Event time replaces the wall clock: an entry expires when an event of its tenant comes after its time to live.
State is per tenant and bounded: the last 80 accepted payloads, and the event ids within their time to live.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakesieve.functions.spamrules import BLOCK, SCORES, SOFT
from lakesieve.operators.leaders import similarity, word_set

#: Accepted payloads that a tenant is compared with.
RECENT = 80
_OUT = "tenant string, delivery_id long, duplicate boolean, reason string"


class TenantMemory:
    """What a tenant's events are checked against."""

    def __init__(self, state: dict | None = None) -> None:
        state = state or {}
        self.ids: dict[str, float] = state.get("ids", {})
        self.recent: list[tuple[str, str]] = [tuple(x) for x in state.get("recent", [])]
        self.words: list[frozenset[str] | None] = [None] * len(self.recent)
        self.until: float = state.get("until", 0.0)

    def dump(self) -> dict:
        return {"ids": self.ids, "recent": self.recent, "until": self.until}

    def repeat_of(self, fingerprint: str, normalized: str, threshold: float) -> tuple[str | None, frozenset[str] | None]:
        """(burst, near_duplicate or None; the words of the payload if they were needed): the first entry that matches counts."""
        words = None
        for i, (finger, norm) in enumerate(self.recent):
            if finger == fingerprint:
                return "burst", words
            if norm and normalized:
                words = words if words is not None else word_set(normalized)
                if self.words[i] is None:
                    self.words[i] = word_set(norm)
                few, many = sorted((len(words), len(self.words[i])))
                if few >= threshold * many and similarity(normalized, norm, words, self.words[i]) >= threshold:
                    return "near_duplicate", words
        return None, words

    def push(self, fingerprint: str, normalized: str, words: frozenset[str] | None, at: float, window_ms: float, most: int) -> None:
        self.recent = [(fingerprint, normalized), *self.recent][:most]
        self.words = [words, *self.words][:most]
        self.until = at + max(60, ceil(window_ms / 1000) * 2)

    def judge(self, event_id: str | None, fingerprint: str, normalized: str, at: float, window_ms: float, remember: bool, threshold: float, always: bool = False, most: int = RECENT) -> tuple[bool, str | None]:
        """(whether the id was seen, burst or near_duplicate or None); with ``always`` R5: duplicates are remembered too."""
        ttl = max(60, ceil(window_ms / 1000))
        if at >= self.until:
            self.recent, self.words = [], []
        if len(self.ids) > 1024:
            self.ids = {k: v for k, v in self.ids.items() if v > at}
        repeat, words = self.repeat_of(fingerprint, normalized, threshold)
        seen = bool(event_id) and self.ids.get(event_id, float("-inf")) > at
        if event_id and not seen and remember:
            self.ids[event_id] = at + ttl
        if remember and (always or not (seen or repeat)):
            self.push(fingerprint, normalized, words, at, window_ms, most)
        return seen, repeat

    def check(self, event_id: str | None, fingerprint: str, normalized: str, at: float, window_ms: float, remember: bool = True, threshold: float = 0.85) -> str | None:
        """Why the event is a duplicate (duplicate_event, burst, near_duplicate), or None; ``at`` in seconds.

        An id lives for max(60, window) seconds from its first sight, which later sights don't extend; accepted
        payloads live for max(60, 2 * window) seconds, extended by each new one.
        """
        seen, repeat = self.judge(event_id, fingerprint, normalized, at, window_ms, remember, threshold)
        return "duplicate_event" if seen else repeat


def replay(events: DataFrame, threshold: float = 0.85) -> DataFrame:
    """R6 over a batch: (tenant, delivery_id, duplicate, reason) of every event.

    events: (tenant, delivery_id, event_id, fingerprint, normalized, at timestamp, window_ms, remember). A
    tenant's events are decided in order of time and delivery id, which the semantics require; they stream
    through one task, whose memory is the tenant's bounded state. Null tenants share one; null times come first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, memory = object(), TenantMemory()
        for pdf in batches:
            out = []
            for t, d, e, f, n, at, w, r in pdf.itertuples(index=False):
                if t != tenant:
                    tenant, memory = t, TenantMemory()
                reason = memory.check(e, f or "", n or "", at, w, bool(r), threshold)
                out.append((t, d, reason is not None, reason))
            yield pd.DataFrame(out, columns=["tenant", "delivery_id", "duplicate", "reason"])

    rows = events.select(
        F.coalesce("tenant", F.lit("")).alias("tenant"), F.col("delivery_id").cast("long"), "event_id", "fingerprint", "normalized",
        F.coalesce(F.col("at").cast("timestamp").cast("double"), F.lit(0.0)).alias("at"), F.coalesce(F.col("window_ms").cast("double"), F.lit(120_000.0)).alias("window_ms"), F.coalesce("remember", F.lit(True)).alias("remember"),
    )
    return rows.repartition("tenant").sortWithinPartitions("tenant", "at", "delivery_id").mapInPandas(run, _OUT)


_DECIDED = "tenant string, delivery_id long, duplicate boolean, decision string, score double, reasons array<string>"


def decided(events: DataFrame, kind: str = "event", threshold: float = 0.85) -> DataFrame:
    """R6 (``event``) or R5 (``spam``) over a batch, in full: (tenant, delivery_id, duplicate, decision, score, reasons).

    events: the columns of ``replay`` and score and reasons without memory. A repeat raises the score; an event that
    is a duplicate is not allowed and gets the reason duplicate_event. R5 has no ids and remembers every payload.
    """
    always, most = (True, 40) if kind == "spam" else (False, RECENT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, memory = object(), TenantMemory()
        for pdf in batches:
            out = []
            for t, d, e, f, n, at, w, r, score, reasons in pdf.itertuples(index=False):
                if t != tenant:
                    tenant, memory = t, TenantMemory()
                seen, repeat = memory.judge(None if always else e, f or "", n or "", at, w, bool(r), threshold, always, most)
                why = [] if reasons is None else list(reasons)
                blank = why == ["empty"]
                if repeat and not blank:
                    why, score = [*why, repeat], max(score, SCORES[repeat])
                duplicate = seen or (repeat is not None and not blank)
                decision = "soft_reject" if blank else "block" if score >= BLOCK else "soft_reject" if score >= SOFT else "allow"
                if duplicate and not always:
                    decision = "soft_reject" if decision == "allow" else decision
                    why = [*why, "duplicate_event"]
                out.append((t, d, duplicate, decision, round(score, 3), why))
            yield pd.DataFrame(out, columns=["tenant", "delivery_id", "duplicate", "decision", "score", "reasons"])

    rows = events.select(
        F.coalesce("tenant", F.lit("")).alias("tenant"), F.col("delivery_id").cast("long"), "event_id", "fingerprint", "normalized",
        F.coalesce(F.col("at").cast("timestamp").cast("double"), F.lit(0.0)).alias("at"), F.coalesce(F.col("window_ms").cast("double"), F.lit(120_000.0)).alias("window_ms"), F.coalesce("remember", F.lit(True)).alias("remember"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "reasons",
    )
    return rows.repartition("tenant").sortWithinPartitions("tenant", "at", "delivery_id").mapInPandas(run, _DECIDED)


def stream(events: DataFrame, threshold: float = 0.85) -> DataFrame:
    """R6 over a stream with the columns of ``replay``: one output row an event, state kept by tenant."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = TenantMemory(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["at", "delivery_id"])
        out = []
        for x in rows.itertuples(index=False):
            reason = memory.check(x.event_id, x.fingerprint or "", x.normalized or "", x.at, x.window_ms, bool(x.remember), threshold)
            out.append((key[0], x.delivery_id, reason is not None, reason))
        state.update((json.dumps(memory.dump()),))
        yield pd.DataFrame(out, columns=["tenant", "delivery_id", "duplicate", "reason"])

    rows = events.select(
        F.coalesce("tenant", F.lit("")).alias("tenant"), F.col("delivery_id").cast("long"), "event_id", "fingerprint", "normalized",
        F.col("at").cast("timestamp").cast("double").alias("at"), F.coalesce(F.col("window_ms").cast("double"), F.lit(120_000.0)).alias("window_ms"), F.coalesce("remember", F.lit(True)).alias("remember"),
    )
    return rows.groupBy("tenant").applyInPandasWithState(run, _OUT, "memory string", "append", GroupStateTimeout.NoTimeout)


def first_sights(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The id half of R6 by built-in state: events whose keys were not seen within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)

"""Near-duplicates and history against brute force."""

import random
from math import ceil

import numpy as np
import pytest

from lakesieve.llm import history
from lakesieve.llm.history import BEFORE, HashForest, replay, widest_depth
from lakesieve.llm.neardup import link_counts, similar_pairs
from lakesieve.llm.signatures import SizeClasses, words_of
from lakesieve.sources.sorted_files import SortedFiles


def jaccard(a, b):
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 0.0


def texts(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rng.shuffle(w)
        else:
            w = rng.choices(words, k=rng.randint(4, 40))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("threshold", "least"), [(0.85, 8), (0.8, 5), (0.6, 3)])
def test_pairs_equal_brute_force(spark, threshold, least):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(7, 150))]
    rows += [(1000, None, "x", 1), (None, rows[0][1], "x", 1), (1001, "", "x", 1), rows[3], (1002, "É " * 9, "x", 1)]
    df = spark.createDataFrame(rows, "doc long, body string, key string, size int")
    got = {tuple(r) for r in similar_pairs(df, "doc", "body", threshold, least).collect()}
    sets = {i: words_of(t) for i, t, *_ in rows if i is not None and t and len(words_of(t)) >= least}
    true = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= threshold - 1e-9}
    assert got == true and true
    links = {r.id: (r.class_id, r.links) for r in link_counts(df, "doc", "body", threshold, least).collect()}
    assert links == {i: (min(j for j in sets if sets[j] == sets[i]), sum(i in p for p in true)) for i in sets}


def test_empty_and_hot(spark):
    schema = "doc long, body string"
    assert similar_pairs(spark.createDataFrame([], schema), "doc", "body").count() == 0
    hot = spark.createDataFrame([(i, "one two three four five six") for i in range(300)], schema)
    rows = link_counts(hot, "doc", "body").collect()
    assert len(rows) == 300 and {(r.class_id, r.links) for r in rows} == {(0, 299)}


def test_size_classes_cover_all_pairs():
    for t in (0.5, 0.8, 0.85, 0.9):
        c = SizeClasses(t, 3)
        c.reach(400)
        for i, (low, high) in enumerate(zip(c.low, c.high, strict=True)):
            for a in range(low, high + 1):
                for b in range(a, int(a / t) + 1):
                    j = next(k for k, h in enumerate(c.high) if b <= h) if b <= c.high[-1] else None
                    if j is None:
                        continue
                    assert j - i in (0, 1)
                    assert a + b - 2 * ceil(t / (1 + t) * (a + b) - 1e-9) <= c.differ[j]
                    assert j == i or a >= t * c.low[j] - 1e-9


def test_pairs_across_size_classes_and_partitions(spark):
    words = [f"w{i}" for i in range(130)]
    rows = []
    for n in (10, 14, 105):  # the largest sizes of their classes at 0.85 from 8 words on
        rows += [(n, " ".join(words[:n])), (1000 + n, " ".join(words[: n + 1]))]
    sets = {i: words_of(t) for i, t in rows}
    true = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.85 - 1e-9}
    apart = spark.sparkContext.parallelize(rows, len(rows)).toDF("doc long, body string")
    assert {tuple(r) for r in similar_pairs(apart, "doc", "body", 0.85, 8).collect()} == true and (10, 1010) in true


def test_common_prefixes_are_lengthened_and_cut(spark, monkeypatch):
    from lakesieve.llm import neardup

    monkeypatch.setattr(neardup, "SAMPLE", 1)
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):  # edited copies of one template, most prefixes shared by many
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(40)] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc long, body string").repartition(5)
    sig = neardup.signed(df, "doc", "body", 0.85, 8)
    _, common = neardup._lengthened(sig)
    assert common is not None and common.agg({"sets": "max"}).first()[0] > 20  # so at least five chunks
    sets = {i: words_of(t) for i, t in rows}
    true = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.85 - 1e-9}
    assert {tuple(r) for r in similar_pairs(df, "doc", "body", 0.85, 8).collect()} == true


def results(spark, seed, n=160, batches=6):
    rng = random.Random(seed)
    rows = []
    for i, t in enumerate(texts(seed, n)):
        rows.append((i, f"t{rng.randint(0, 2)}" if rng.random() < 0.95 else None, rng.randint(1, batches), rng.choice(["f1", "f2", f"g{i}", None]), t))
    rows.append(rows[5])
    old = [("t0", [("f1", None), ("zz", rows[3][4]), (None, rows[9][4])]), ("t1", None), ("t2", []), (None, [("q", rows[2][4])])]
    return rows, old


def brute_force(rows, old):
    history = {t: [(f, None if n is None else words_of(n)) for f, n in e or []] for t, e in old}
    cases = set()
    unique = {r[0]: r for r in rows}.values()
    for b in sorted({r[2] for r in unique}):
        fresh = []
        for i, t, batch, f, text in unique:
            w = words_of(text)
            if batch != b or len(w) < 8:
                continue
            if any((f is not None and f == g and (h is None or jaccard(w, h) >= 0.5)) or (h is not None and jaccard(w, h) >= 0.85) for g, h in history.get(t, [])):
                cases.add(i)
            else:
                fresh.append((t, f, w))
        for t, f, w in fresh:
            history.setdefault(t, []).append((f, w))
    return cases


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_brute_force_and_forest(spark, seed):
    rows, old = results(spark, seed)
    df = spark.createDataFrame(rows, "request_id long, tenant string, batch_no int, fingerprint string, normalized string")
    opts = spark.createDataFrame(old, "tenant string, recent_fingerprints array<struct<fingerprint:string,normalized:string>>")
    true = brute_force(rows, old)
    assert {r[0] for r in replay(df, opts).collect()} == true and true
    if seed == 1:
        forest, found = HashForest(spark, most_runs=3), set()
        forest.seed(opts)
        for b in range(1, 7):
            found |= {r[0] for r in forest.accept(df.where(f"batch_no = {b}")).collect()}
        assert found == true and len(forest.runs) <= 4


def test_replay_empty(spark):
    df = spark.createDataFrame([], "request_id long, tenant string, batch_no int, fingerprint string, normalized string")
    assert replay(df, None).count() == 0


def test_chains_and_depth(spark):
    words = [f"w{i}" for i in range(40)]
    texts_ = [" ".join(words), " ".join([*words[3:], "a", "b", "c"]), " ".join([*words[6:], "a", "b", "c", "d", "e", "f"])]
    rows = [(i, "t", i + 1, None, t) for i, t in enumerate(texts_)]
    df = spark.createDataFrame(rows, "request_id long, tenant string, batch_no int, fingerprint string, normalized string")
    assert {r[0] for r in replay(df, None).collect()} == brute_force(rows, []) == {1}  # 1 repeats 0, so it is no history for 2
    assert widest_depth(0.85, 8, 4, 0.999) == 3 and BEFORE < 0


def test_hot_history_is_searched_in_full(spark, monkeypatch):
    monkeypatch.setattr(history, "AT_FIRST", 2)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(80):  # copies of one template with edits, most of them in the first batch
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(30)] = f"x{rng.randint(0, 400)}"
        rows.append((i, "t", 1 if i < 50 else 2 + i % 3, None, " ".join(w)))
    df = spark.createDataFrame(rows, "request_id long, tenant string, batch_no int, fingerprint string, normalized string")
    assert {r[0] for r in replay(df, None).collect()} == brute_force(rows, [])


def test_store_of_many_partitions(spark, tmp_path):
    """Work per batch must not grow with files times entries: an entry is in one file, and a footer is read once."""
    rows, _ = results(spark, 4)
    rows = [(*r[:2], None if r[2] == 1 else r[2], *r[3:]) for r in rows] + [(1000 + i, *rows[7][1:]) for i in range(30)]
    df = spark.createDataFrame(rows, "request_id long, tenant string, batch_no int, fingerprint string, normalized string").repartition(12)
    forest = HashForest(spark, str(tmp_path / "forest"))
    run = forest.add(history._rows(df, None))
    files = SortedFiles(f"{run}/texts")
    spans = sorted(s for name in files.names for s in files.ranges(name))
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert files.count() == history._rows(df, None).select("c").distinct().count()
    assert {r[0] for r in replay(df, None).collect()} == brute_force([(*r[:2], r[2] or 0, *r[3:]) for r in rows], [])


def test_sharing_searches_the_longer_side():
    long = np.sort(np.random.default_rng(1).integers(0, 500, 4000))
    short = np.sort(np.random.default_rng(2).integers(0, 900, 60))
    assert history._sharing(long, short).tolist() == np.flatnonzero(np.isin(long, short)).tolist()
    assert not len(history._sharing(long, short[:0]))

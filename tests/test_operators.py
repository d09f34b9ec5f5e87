"""Core operators on small cases: nulls, empty tables, ties, repeated rows, extra columns."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lakesieve.operators import dedupe as D
from lakesieve.operators import folder as P
from lakesieve.operators import leaders as L
from lakesieve.operators import media as M
from lakesieve.operators import usage as U
from lakesieve.operators.cleaning import clean_lines
from lakesieve.operators.components import connected_components, most_distance
from lakesieve.operators.redelivery import DeliveryLog, repeated_deliveries
from lakesieve.operators.verify import Checkpoints, first_passing, line_checks, relaxed
from lakesieve.streaming.events import TenantMemory, replay


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, line string")


def test_line_dedupe(spark):
    lines = D.positioned(docs(spark, "a\nb\n a\n\na", None, "", "b"))
    u = D.unique_lines(D.keyed_lines(lines), True)
    assert {(r.line, r.n) for r in u.collect()} == {("a", 3), ("b", 2)}
    s = D.stats(lines, u).first()
    assert (s.total, s.removed, s.remaining) == (5, 3, 2)
    assert {r.line for r in D.stacked(u).collect()} == {"x3 a", "x2 b"}
    caps = D.unique_lines(D.keyed_lines(D.positioned(docs(spark, "Hello\nhello")), ignore_case=True)).collect()
    assert [(r.line, r.n) for r in caps] == [("Hello", 2)]
    assert D.unique_lines(D.keyed_lines(D.positioned(docs(spark)))).count() == 0
    assert all(r.ok for r in line_checks(D.stats(lines, u)).collect())


def test_todo_and_csv(spark):
    t = D.unique_todos(D.keyed_lines(D.positioned(docs(spark, "- [ ] milk\n- [x] milk")), fmt="todo")).collect()
    assert [(r.line, r.n) for r in t] == [("- [x] milk", 2)]
    rows = D.csv_rows(docs(spark, "\nh1,h2\n1,2\n1,2", None)).orderBy("pos").collect()
    assert [(r.row, r.n, r.is_header) for r in rows] == [("h1,h2", 1, True), ("1,2", 2, False)]


def test_json_dedupe(spark):
    items = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, '{"a":2, "b":1}'), (3, None), (4, "nope")], "id long, j string")
    assert {(r.key, r.n, r.first) for r in D.unique_json(items, "id", "j").collect()} == {('{"a":2,"b":1}', 2, 1), ("nope", 1, 4)}


def test_leaders(spark):
    assert L.best_leaders(["red green blue", "red green blue sky"], 0.7) == [(0, 2)]
    assert L.best_leaders(["ab cd", "ab cd efgh ijkl mnop"], 0.3) == [(0, 1), (1, 1)]
    assert L.any_match(["a b", "a b", "c"], 1.0) == [False, True, False]
    rng = random.Random(1)
    for _ in range(30):
        keys = [" ".join(rng.choices("abcdef", k=rng.randint(1, 6))) for _ in range(25)]
        slow: list[list] = []
        for i, k in enumerate(keys):
            exact = next((x for x in slow if x[1] == k), None)
            near = [(L.similarity(k, x[1], L.word_set(k), L.word_set(x[1])), -j) for j, x in enumerate(slow) if abs(len(x[1]) - len(k)) <= 0.6 * len(k)]
            if exact:
                exact[2] += 1
            elif near and max(near)[0] >= 0.5:
                slow[-max(near)[1]][2] += 1
            else:
                slow.append([i, k, 1])
        assert L.best_leaders(keys, 0.5) == [(x[0], x[2]) for x in slow]


def test_clean_lines(spark):
    text = "legit inquiry about pricing\nBUY NOW http://x.com http://y.com http://z.com http://w.com\nlegit inquiry about pricing\n\nanother real line"
    rows = clean_lines(docs(spark, text, None), "doc_id", "text").orderBy("index").collect()
    assert [r.kept for r in rows] == [True, False, False, True, True]


def test_folder(spark):
    files = spark.createDataFrame(
        [("p/data/users.csv", "name\na"), ("p/backup/users-copy.csv", "name\na"), ("p/logs/app.log", "x"), ("p/logs/app.log.bak", "x"), ("p/n.md", None), (None, "z"), ("p/readme.md", "# t\n# t\nd")], "path string, content string"
    )
    rows = {r.path: r for r in P.duplicate_files(files).collect()}
    assert not rows["p/backup/users-copy.csv"].kept and rows["p/data/users.csv"].kept
    assert rows["p/logs/app.log"].kept and rows["p/logs/app.log.bak"].kept  # app is an entry point
    s = P.folder_stats(files, P.duplicate_files(files)).first()
    assert (s.files, s.groups, s.removed) == (6, 2, 1)
    kept = {(r.path, r.line_no): r.kept for r in P.cross_file_lines(files).collect()}
    assert kept[("p/readme.md", 0)] and not kept[("p/readme.md", 1)]
    assert sum(kept.values()) == 5
    paths = spark.createDataFrame([("a/node_modules/b.js",), ("src/x.min.js",), ("docs/old/y.md",)], "path string")
    got = paths.select("path", P.ignored(F.col("path")).alias("i"), P.skipped(F.col("path"), P.skip_rules("*.min.js # generated\nold")).alias("s")).collect()
    assert [(r.i, r.s) for r in got] == [(True, False), (False, True), (False, True)]
    code = spark.createDataFrame([("a/m1.py", "def f(x):\n    return x + 1\n\nz = 1"), ("a/m2.py", "def f(x):\n    return x + 1\n"), ("b/j.js", "function g() {\n return 1;\n}\n")], "path string, content string")
    blocks = P.code_blocks(code)
    assert blocks.count() == 3
    assert [(r.copies, r.intentional, r.keeper) for r in P.duplicate_blocks(blocks).collect()] == [(2, False, "a/m1.py")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_media(spark):
    assert (most_distance(92), most_distance(100), most_distance(10)) == (5, 0, 16)
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(M.distinct_frames(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(7).cast("long")))) == [0, 7]
    assert M.warped_similarity(__import__("numpy").zeros((5, 5))) == 1.0
    assert abs(one(M.hue_similarity(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))) - 1) < 1e-9
    px = spark.createDataFrame([([float(i) for i in range(81)], 9, 9)], "p array<double>, w int, h int")
    r = px.select(M.difference_hash(F.col("p"), F.col("w"), F.col("h")).alias("d"), M.average_hash(F.col("p")).alias("a")).first()
    assert r.d == -1 and r.a == (1 << 24) - 1


def test_usage(spark):
    t0 = datetime(2024, 1, 1)
    calls = spark.createDataFrame([(i, "t", t0 + timedelta(hours=30 * i)) for i in range(3)] + [(9, None, t0), (10, "t", None)], "id long, tenant string, ts timestamp")
    assert {(r.tenant, str(r.day), r.calls) for r in U.daily_usage(calls, "tenant", "ts").collect()} == {("t", "2024-01-01", 1), ("t", "2024-01-02", 1), ("t", "2024-01-03", 1), (None, "2024-01-01", 1)}
    assert [r.calls for r in U.usage_history(U.daily_usage(calls, "tenant", "ts")).orderBy("day").collect()] == [0, 0, 0, 0, 2, 1, 1]
    q = U.within_quota(calls.where("ts is not null"), "tenant", "ts", "id", F.lit(0)).collect()
    assert not any(r.admitted for r in q)


def deliveries(spark, rows):
    return spark.createDataFrame(rows, "delivery_id long, tenant string, event_id string, fingerprint string, sent_at timestamp, received_at timestamp, bucket string, h int")


def test_redelivery(spark):
    t = datetime(2024, 1, 1)
    m = lambda i, e, days, f="f", sent=t, tenant="t": (i, tenant, e, f, sent, t + timedelta(days=days), "x", 1)
    rows = [m(1, " a\t", 3), m(2, "a", 1), m(3, "A", 0), m(4, "a", 1), m(5, None, 0), m(6, "  ", 5), m(7, None, 9, "g"), m(8, "a", 0, tenant="u"), m(8, "a", 0, tenant="u"), (9, None, None, None, None, None, "x", 1), (10, None, None, None, None, None, "x", 1)]
    assert sorted(r[0] for r in repeated_deliveries(deliveries(spark, rows)).collect()) == [1, 4, 6, 10]
    assert repeated_deliveries(deliveries(spark, [])).count() == 0
    hot = [m(i, "hot" if i % 3 == 0 else f"e{i}", i % 7) for i in range(600)]
    assert repeated_deliveries(deliveries(spark, hot)).count() == 199


def test_delivery_log(spark):
    t = datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, "t", f"e{rng.randint(0, 60)}", "f", t, t + timedelta(hours=i), "x", 1) for i in range(120)]
    log, gone = DeliveryLog(spark), set()
    for start in (0, 40, 80):
        gone |= {r[0] for r in log.accept(deliveries(spark, rows[start : start + 40])).collect()}
    assert gone == {r[0] for r in repeated_deliveries(deliveries(spark, rows)).collect()}


def test_delivery_log_opens_files_of_its_ranges(spark, tmp_path):
    """Work per batch must not grow with tasks times days: what a range has stored lies in folders of its own."""
    t = datetime(2024, 1, 1)
    rng = random.Random(4)
    rows = [(i, "t", f"e{rng.randint(0, 400)}", "f", t, t + timedelta(hours=rng.randint(0, 900)), "x", 1) for i in range(900)]
    batch = [rng.choice([None, 1, 2, 3]) for _ in rows]
    log = DeliveryLog(spark, str(tmp_path / "log"))
    log.add(deliveries(spark, rows).repartition(8))
    ids = f"{log.runs[0]}/ids"
    files = {d: len([f for f in os.listdir(f"{ids}/{d}") if f.endswith(".parquet")]) for d in os.listdir(ids) if "=" in d}
    assert len(files) > 4 and set(files.values()) == {1}
    best = {}
    for r in rows:
        best[r[2]] = min(best.get(r[2], (r[5], r[0])), (r[5], r[0]))
    whole = deliveries(spark, rows).join(spark.createDataFrame([(r[0], b) for r, b in zip(rows, batch, strict=True)], "delivery_id long, batch_no int"), "delivery_id")
    assert {r[0] for r in repeated_deliveries(whole).collect()} == {r[0] for r in rows} - {b[1] for b in best.values()}
    assert {r[0] for r in repeated_deliveries(whole, most_runs=2).collect()} == {r[0] for r in rows} - {b[1] for b in best.values()}


def test_event_memory(spark):
    m = TenantMemory()
    assert m.check("a", "f1", "one two three", 0, 120_000) is None
    assert m.check("a", "f2", "x", 100, 120_000) == "duplicate_event"
    assert m.check("b", "f1", "zzz", 110, 120_000) == "burst"
    assert m.check("a", "f3", "unrelated words here", 130, 120_000) is None  # the id has expired
    assert TenantMemory(m.dump()).check("a", "f9", "k", 131, 120_000) == "duplicate_event"
    t = datetime(2024, 1, 1)
    rows = [("t", i, "e", f"f{i}", "", t + timedelta(seconds=s), 60_000, True) for i, s in enumerate((0, 30, 61, 200))]
    ev = spark.createDataFrame(rows, "tenant string, delivery_id long, event_id string, fingerprint string, normalized string, at timestamp, window_ms long, remember boolean")
    assert [r.duplicate for r in replay(ev).orderBy("delivery_id").collect()] == [False, True, False, False]


def test_stream_equals_replay(spark, sf, tmp_path):
    from lakesieve.functions.text import js_trim
    from lakesieve.streaming.events import stream

    c = spark.read.parquet(f"{sf}/check_requests.parquet").select("tenant", "delivery_id", js_trim(F.col("event_id")).alias("event_id"), "fingerprint", F.lit("").alias("normalized"), F.col("received_at").alias("at"), F.lit(86_400_000).alias("window_ms"), "remember")
    c.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("checked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert Counter(map(tuple, spark.table("checked").collect())) == Counter(map(tuple, replay(c).collect()))


def test_retries_and_checkpoints(spark):
    assert [round(relaxed(1.0, i), 2) for i in (1, 2, 3)] == [1.0, 0.92, 0.84]
    n, df = first_passing([lambda: spark.range(0), lambda: spark.range(2)], lambda d: not d.isEmpty())
    assert (n, df.count()) == (2, 2)
    c = Checkpoints(2)
    for i in range(3):
        c.push(str(i), spark.range(i))
    assert (c.revert()[0], c.revert()[0], len(c.states)) == ("2", "1", 0)


def test_scratch_is_dropped(spark):
    import os

    from lakesieve.session import drop_scratch, materialize

    df = materialize(spark.range(3), "kept")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 3 and os.path.exists(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path)


def test_blocks_and_lines_within_files(spark):
    body = "def f(x):\n    return x + 1\n"
    code = spark.createDataFrame([("a/m1.py", body + "z = 1"), ("a/m2.py", body + "y = 2\n\n" + body), ("a/n.py", None)], "path string, content string")
    left = {r.path: r.content for r in P.remove_blocks(code, P.code_blocks(code)).collect()}
    assert left == {"a/m1.py": body + "z = 1", "a/m2.py": "y = 2\n"}
    files = spark.createDataFrame([("a", "x\nx\n\ny"), ("b", "# stay\nx\nx"), ("c", "1\n2\n"), (None, "x")], "path string, content string")
    got = {r.path: (r.content, r.removed) for r in P.within_file_lines(files, marker="# stay").collect()}
    assert got == {"a": ("x\ny", 1), "b": ("# stay\nx\nx", 0), "c": ("1\n2\n", 0)}


def test_target(spark):
    items = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, None)], "item long, dhash long")
    assert {(r.item, r.distance) for r in M.matches_of_target(items, {"dhash": 1}).collect()} == {(1, 1), (2, 2)}


def test_folder_project(spark):
    from lakesieve.operators.project import process_project

    users = "name,email\nalice,a@x.com\nbob,b@x.com\nalice,a@x.com"
    log = "[2024-01-01] INFO Started\n[2024-01-01] INFO Started\n[2024-01-02] ERROR fail"
    rows = [
        ("my-project/data/users.csv", users, "csv"), ("my-project/backup/users-copy.csv", users, "csv"), ("my-project/logs/app.log", log, "log"),
        ("my-project/logs/app.log.bak", log, "log"), ("my-project/readme.md", "# My Project\n# My Project\nSetup complete.", "txt"), ("node_modules/x.js", "a", None), (None, "x", None),
    ]
    files, stats = process_project(spark.createDataFrame(rows, "path string, content string, format string"), "safe", fmt="format")
    s = stats.first()
    assert (s.files, s.files_removed, s.duplicate_groups, s.lines_removed, s.files_modified, s.files_kept) == (5, 1, 2, 6, 5, 4)
    left = {r.path: r.content for r in files.where("not deleted").collect()}
    assert left["my-project/readme.md"] == "# My Project\nSetup complete." and left["my-project/logs/app.log.bak"] == "" and "my-project/backup/users-copy.csv" not in left
    kept = [("a.txt", "one\n\ntwo # dedupe: keep-line\nthree", "txt"), ("b.txt", "three\none\nfour", "txt"), ("c.txt", "# dedupe: keep\none\none", "txt")]
    from lakesieve.options import FolderScope

    scope = FolderScope(keep_file=r"dedupe:\s*keep(?!-)")
    files, _ = process_project(spark.createDataFrame(kept, "path string, content string, format string"), scope, fmt="format")
    left = {r.path: r.content for r in files.collect()}
    assert left == {"a.txt": "one\n\ntwo # dedupe: keep-line\nthree", "b.txt": "three\nfour", "c.txt": "# dedupe: keep\none\none"}
    empty, none = process_project(spark.createDataFrame([], "path string, content string"), "aggressive")
    assert empty.count() == 0 and none.first().files == 0


def test_json_rendering_and_keys(spark):
    from lakesieve.functions.jsonx import render
    from lakesieve.functions.text import comparison_key

    assert render('{"b":1,"a":2}\n{"a":2,"b":1}\n"x"\nnot json') == ['{"b":1,"a":2}', "x", "not json"]
    assert render("[1, 1.0, 100, 1e2]", stack=True) == ["x2 1", "x2 100"]
    assert render('[{"a": []}, {"a": []}]') == ["[", "  {", '    "a": []', "  }", "]"]
    df = spark.createDataFrame([('{"b": 1, "a": 2}',), ("x",)], "line string")
    assert [r[0] for r in df.select(comparison_key(F.col("line"), fmt="json")).collect()] == ['{"a":2,"b":1}', "x"]
    code = spark.createDataFrame([("x = a // b + c  # half", "python"), ("i = n--;", "css"), ("a(); // b", "java"), ("<p>k</p><!-- c -->", "html")], "line string, lang string")
    from lakesieve.functions.text import strip_line_comments

    assert [r[0] for r in code.select(strip_line_comments(F.col("line"), F.col("lang"))).collect()] == ["x = a // b + c", "i = n--;", "a();", "<p>k</p>"]

"""Look-alikes, personal information, tokens, containers and cut texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesieve.llm import cutoff, packing, tokens
from lakesieve.llm.lookalike import plain_form, plain_with_offsets, same_look_pairs
from lakesieve.llm.personal import Labelers, expectation_maximisation, found_places, masked, train_classifier


def test_plain_forms():
    same = ["Final café Ｘ", "Fi​nal café X", "ﬁnal".replace("ﬁ", "Fi") + " café Х"]
    assert len({plain_form(s, False) for s in same}) == 1
    assert plain_form("Straße", True) == plain_form("STRASSE", True)
    assert plain_form("a", False) != plain_form("A", False)
    assert plain_form("a  b", False) != plain_form("a b", False)
    assert plain_form(None) is None and plain_form("​") == ""


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_plain_form_is_stable(s):
    for fold in (True, False):
        once = plain_form(s, fold)
        assert plain_form(once, fold) == once
    plain, at = plain_with_offsets(s)
    assert at is None and len(plain) == len(s) or len(at) == len(plain)


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, text string, fields map<string,string>, look long, stored long")


def test_same_look(spark):
    rows = [(1, "My tea", None, 1, 1), (2, "Мy tea", None, 1, 1), (3, "My tea", None, 1, 1), (4, None, {"a": "x", "b": None}, 1, 1), (5, None, {"b": None, "a": "х"}, 1, 1), (6, None, {"a": "x", "b": ""}, 1, 1), (7, None, None, 1, 1), (8, "", None, 1, 1), (9, "​", None, 1, 1), (10, None, {"c": "x", "b": None}, 1, 1)]
    rows += [rows[1], (None, "My tea", None, 1, 1)]
    assert sorted(map(tuple, same_look_pairs(requests(spark, rows)).collect())) == [(1, 2), (2, 3), (4, 5), (8, 9)]
    assert same_look_pairs(requests(spark, [])).count() == 0


def test_same_look_hot(spark):
    rows = [(i, "yes", None, 1, 1) for i in range(500)] + [(900, "y‍es", None, 1, 1)]
    assert same_look_pairs(requests(spark, rows)).count() == 500


NAMES = [("Ada", "given"), ("Rose", "given"), ("Varrowby", "family"), ("Skeldrin", "family")]


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to ada.x+1@mail.osterby.example please", {"email"}), ("mail ada_x(at)osterby(dot)example", {"email"}), ("ada at osterby dot example", {"email"}), ("meet @ noon or write @ once.", set()),
        ("Tel: +44 7700 900123 ext. 4", {"phone"}), ("call me on (555) 010 0123 after six", {"phone"}), ("the epoch value was 1752021396 in the log", set()), ("host 203.0.113.5 answered", set()), ("order number 6001-42007 left", set()),
        ("They asked for 937-39-9546 on the form", {"idnumber"}), ("my papers say qq 28 34 76 b", {"idnumber"}), ("enclosed: passport no. z73820776", {"idnumber"}),
        ("deliver it to Flat 9, 12 Saltmarsh Way.", {"address"}), ("we moved from 25 rue des Tisserands", {"address"}), ("calle Olmos 96, 2º B", {"address"}), ("Kirschgartenstraße 49", {"address"}), ("a 5 way street plan", set()),
        ("Ada Skeldrin told me to write here.", {"name"}), ("signed by: mevi gadovo.", {"name"}), ("Skeldrin", {"name"}), ("we will see rose beds in may", set()), ("my name is on the list of 7 items", set()),
    ],
)
def test_spans(text, kinds):
    base = [("a@b.example x", "normalized"), ("tel +1 555 010 0144", "x"), ("call 555-0101", "x"), ("ssn 999 99 9999 on the form", "x"), ("deliver it to 9 Foxglove Road please", "x"), ("Ada Varrowby", "name"), ("we saw rose there", "x"), ("order number 6001-42007", "x"), ("signed by: Ada Varrowby.", "x"), ("my name is on the list of 5 items", "x"), ("a 6 way street plan", "x")]
    lab = Labelers(NAMES, {"rose"})
    counts: dict[str, int] = {}
    for t, place in [*base * 20, (text, "message")]:
        for _, p, *_ in lab.spans(t, place):
            counts[p] = counts.get(p, 0) + 1
    chance = train_classifier(sorted(counts.items()))
    assert {k for k, p, *_ in lab.spans(text, "message") if chance[p] >= 0.5} == kinds


def test_personal_table(spark):
    q = spark.createDataFrame([(1, {"email": "a.b@osterby.example", "message": "Ring +44 7700 900123, ask Ada Skeldrin", "x": None, "y": ""}), (2, None), (None, {"name": "Ada"})], "request_id long, fields map<string,string>")
    r = spark.createDataFrame([(1, "see 9 foxglove road please"), (2, None), (3, "tel ＋44 7700 900123"), (3, "tel ＋44 7700 900123")], "request_id long, normalized string")
    n = spark.createDataFrame([*NAMES, (None, "given")], "name string, kind string")
    got = sorted(map(tuple, found_places(q, r, n).collect()))
    assert got == [(1, "email", "email"), (1, "message", "name"), (1, "message", "phone"), (1, "normalized", "address"), (3, "normalized", "phone")]
    text = {(x.request_id, x.place): x.masked for x in masked(q, r, n).collect()}
    assert text[(1, "message")] == "Ring [PHONE], ask [NAME]" and text[(1, "email")] == "[EMAIL]"
    assert text[(3, "normalized")] == "tel [PHONE]"
    empty = spark.createDataFrame([], q.schema)
    assert found_places(empty, spark.createDataFrame([], r.schema), spark.createDataFrame([], n.schema)).count() == 0


def test_name_lists_are_parted(spark):
    lab = Labelers(NAMES, set())
    for text in ("Ada Varrowby, Rose Skeldrin, Ada Skeldrin", "Varrowby, Ada, Skeldrin, Rose, Skeldrin, Ada", "Ada Varrowby Rose Skeldrin Ada Skeldrin"):
        text = f"We met {text}"
        spans = [text[a:b] for k, _, a, b in lab.spans(text, "message") if k == "name"]
        assert len(spans) == 3 and all(len(x.split()) == 2 for x in spans)
    assert [k for k, *_ in lab.spans("Oro Bel Tasi Umun Keld", "name")] == ["name"]
    q = spark.createDataFrame([(i, {"message": f"We met {t}"}) for i, t in enumerate(["Ada Varrowby", "Rose Skeldrin", "Ada Varrowby, Rose Skeldrin, Ada Skeldrin"])], "request_id long, fields map<string,string>")
    r = spark.createDataFrame([], "request_id long, normalized string")
    n = spark.createDataFrame(NAMES, "name string, kind string")
    assert (2, "message", "name") in set(map(tuple, found_places(q, r, n).collect()))
    assert {x.request_id: x.masked for x in masked(q, r, n).collect()}[2] == "We met [NAME], [NAME], [NAME]"


def test_em_prefers_agreement():
    import numpy as np

    votes = np.array([[1, 1, 0], [1, 0, 0], [0, -1, 0], [1, -1, -1]])
    p = expectation_maximisation(votes, np.array([100.0, 20.0, 50.0, 30.0]))
    assert p[0] > 0.5 and p[2] < 0.5 and p[3] < 0.5 and p[0] >= p[1]


ENC = tokens.encoding(tokens.rank_file())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.integers(5, 40))
def test_tokens_round_trip_and_parts(s, size):
    ids = tokens.encode(s, ENC)
    assert tokens.decode(ids, ENC) == s
    assert "".join(tokens.safe_parts(s, size)) == s
    assert [i for part in tokens.safe_parts(s, size) for i in ENC.encode_ordinary(part)] == ids


def test_encoded(spark):
    long = "many words, 12 of them\n\n  and  blanks " * 9000
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "<|endoftext|>", "z"), (4, long, "z"), (4, long, "z"), (None, "a", "z")], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in tokens.encoded(df).collect()]
    assert (1, []) in got and (2, []) in got and len(got) == 6
    assert [i for d, i in got if d == 4][0] == ENC.encode_ordinary(long)
    assert 50256 not in dict(got)[3]
    back = {r.doc_id: r.text for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert back[3] == "<|endoftext|>" and back[4] == long and back[1] == ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(100, 260))
def test_pack(sizes, capacity):
    windows = packing.pack(sizes, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in w) <= capacity for w in windows)
    if sizes:
        assert len(windows) <= 2 * packing.least_windows(sizes, capacity)


def test_differencing_balances():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    sums = [s for s, _ in packing.difference(sizes, 10)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 20


def test_pack_skips_no_window_count():
    for seed in range(3):
        rng = random.Random(seed)
        sizes = sorted((rng.randint(1, 600) for _ in range(1600)), reverse=True)
        k = len(packing.pack(sizes, 2048))
        fits = [max(total for total, _ in packing.difference(sizes, n)) <= 2048 for n in range(packing.least_windows(sizes, 2048), k)]
        assert fits and not any(fits)


def test_containers(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 900), 7) for i in range(500)] + [(None, 5, 7), (501, 5000, 7), (502, 1024, 7)]
    specs = spark.createDataFrame([(1, "x", 512), (2, "x", 2048), (3, "x", None)], "spec_id int, tokenizer string, capacity_tokens int")
    sizes = spark.createDataFrame(rows, "item_id long, tokens long, block int")
    got = packing.containers(sizes, specs).collect()
    for spec, capacity in ((1, 512), (2, 2048)):
        mine = [r for r in got if r.spec_id == spec]
        rooms: dict[int, int] = {}
        parts: dict[int, list] = {}
        for r in mine:
            rooms[r.container_id] = rooms.get(r.container_id, 0) + r.tokens
            parts.setdefault(r.item_id, []).append((r.start, r.tokens))
        assert max(rooms.values()) <= capacity
        for i, n, _ in rows:
            if i is None or n == 0:
                assert i not in parts
                continue
            assert (len(parts[i]) == 1) == (n <= capacity)
            assert sum(t for _, t in parts[i]) == n
        total = sum(rooms.values())
        assert len(rooms) <= 1.06 * total / capacity + 2
    assert {r.spec_id for r in got} == {1, 2}
    used = {r.spec_id: r.used for r in packing.usage(packing.containers(sizes, specs), specs).collect()}
    assert used[2] > 0.9
    assert packing.containers(sizes.limit(0), specs).count() == 0


DONE = "The team will merge the blue door once the lock is checked. We moved the old table in small steps."


@pytest.mark.parametrize(
    ("text", "fmt", "state"),
    [
        (DONE, "txt", "complete"), (DONE + " 🙂", "txt", "complete"), (DONE + " To be continued...", "txt", "dots"), (DONE[:-9], "txt", "open"), (DONE[:-9] + "�", "txt", "cut"), (DONE[:-6] + " ", "txt", "cut"),
        ('{"a": 1}', "json", "complete"), ('{"a": 1}\n{"b": 2}', "json", "complete"), ('[{"a": 1}, {"b"', "json", "cut"), ("a,b\n1,2\n", "csv", "complete"), ("a,b\n1,2\n3", "csv", "cut"), ('a,b\n1,"2', "csv", "cut"),
        ("2023-01-02T01:02:03Z INFO ok dur=5ms\n2023-01-02T01:02:04Z INFO ok dur=5ms", "log", "open"), (" \n ", "txt", "complete"), ("Hi,\n\nDone now.\n\nThanks,\nAda", "mail", "open"),
    ],
)
def test_ends(text, fmt, state):
    assert cutoff.end_of(text, fmt)[1] == state


def test_cut_documents(spark):
    rng = random.Random(5)
    words = "lamp door table river stone cloud window garden letter bottle".split()
    sentence = lambda: f"The {rng.choice(words)} near the {rng.choice(words)} was moved to the {rng.choice(words)}."
    full = [" ".join(sentence() for _ in range(6)) for _ in range(60)]
    rows = [(i, t, "open", "txt", 0) for i, t in enumerate(full)]
    limited = [(100 + i, t[:120], "short", "txt", 0) for i, t in enumerate(full[:20])]
    rows += limited + [(200, None, "open", "txt", 0), (201, "", None, None, 0), (202, "  ", "open", "txt", 0), (203, full[0][:77], "open", "txt", 0), (204, full[1] + "\r\n", None, None, 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, format string, bytes int")
    got = {r[0] for r in cutoff.cut_documents(docs).collect()}
    assert got == {100 + i for i, t in enumerate(full[:20]) if not t[:120].endswith(".")} | {203}
    lim = {r.source: (r.unit, r["size"]) for r in cutoff.limits(cutoff.facts(docs)).collect()}
    assert lim == {"short": ("chars", 120)}
    known = cutoff.facts(docs)
    assert {r[0] for r in cutoff.prefix_values(known, docs).collect()} == {*range(100, 120), 203}
    shares = {r.source: (r.documents, r.cut) for r in cutoff.cut_shares(docs).collect()}
    assert shares["short"][0] == 20 and shares[None] == (2, 0)
    assert cutoff.cut_documents(docs.limit(0)).count() == 0


def test_longer_copy_overrides_frequency(spark):
    places = ["river", "market", "harbour"]
    full = [f"Crew {i} walked along and rested near {places[i % 3]}. They stayed until noon beside {places[(i + 1) % 3]}." for i in range(60)]
    open_ = [f"Visit {i} began late, the guide of group {i} waited in the rain near river" for i in range(4)]
    rows = list(enumerate(full)) + [(100 + i, t) for i, t in enumerate(open_)]
    rows += [(200, open_[0] + " beds and then went home."), (201, open_[1] + "side cafes."), (202, open_[2] + "\n\nNext day they left.")]
    docs = spark.createDataFrame([(i, t, None, "txt") for i, t in rows], "doc_id long, text string, source string, format string")
    assert {r[0] for r in cutoff.cut_documents(docs).collect()} == {100, 101}


def test_sentences_and_words_are_prefixes(spark):
    whole = "We met in the garden of the old mill. Then the keeper brought us lanterns for the way home."
    rows = [(i, whole + f" Number {i} was there.", "a", "txt") for i in range(4)]
    rows += [(10, "It was late. Then the keeper brought us", "a", "txt"), (11, "Everybody came. They carried lanter", "b", None), (12, "x" * 5000 + "\nname=Ada\nage=4", "b", "form")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, format string")
    got = {r.doc_id: (r.cut, r.evidence) for r in cutoff.evidence(docs).collect()}
    assert got[10] == (True, "sentence") and got[11] == (True, "word") and not got[0][0]
    assert {r.doc_id for r in cutoff.facts(docs).where("kind = 'form'").collect()} <= {12}


def test_first_lines_of_long_texts():
    assert cutoff.kind_of(" " * 9000 + "a=1\nb=2", "form") == "form"
    assert cutoff._first_lines("\n \nab\n\ncd\nef", 2) == ["ab", "cd"]


def test_confusables_and_look_classes(spark):
    from lakesieve.llm.lookalike import confusables, look_classes

    more = confusables(spark)
    assert more[ord("\u13aa")] == "A" and more[ord("\u0430")] == "a" and ord("a") not in more and all(v.isalnum() and v.isascii() for v in more.values())
    rows = [(1, "Anna", None), (2, "\u13aanna", None), (3, "Anna", None), (4, "anna", None), (5, None, None), (6, "", None), (6, "", None)]
    got = {(r.request_id, r.class_id, r.links) for r in look_classes(spark.createDataFrame(rows, "request_id long, text string, fields map<string,string>")).collect()}
    assert got == {(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0), (6, 6, 0)}


def test_repeated_full_items_get_containers_of_their_own(spark):
    sizes = spark.createDataFrame([(1, 8), (1, 8), (2, 3), (2, 3), (3, 20)], "item_id long, tokens long")
    specs = spark.createDataFrame([(1, 8)], "spec_id int, capacity_tokens int")
    rows = packing.containers(sizes, specs).collect()
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
    assert sum(fill.values()) == 42 and max(fill.values()) <= 8 and len(fill) == 6


def test_masked_tells_texts_of_a_request_apart(spark):
    requests = spark.createDataFrame([(1, {"normalized": "mail ada.long@example.com now"})], "request_id long, fields map<string,string>")
    results = spark.createDataFrame([(1, "write to bob@example.org today"), (1, "the box and the lid were already here")], "request_id long, normalized string")
    names = spark.createDataFrame([(1, "Ada", "given")], "name_id int, name string, kind string")
    got = {r.masked for r in masked(requests, results, names).collect()}
    assert got == {"mail [EMAIL] now", "write to [EMAIL] today", "the box and the lid were already here"}

"""Semantics that SQL can't state well, against plain Python versions of the rules."""

import datetime as dt
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kumiki.functions import markup
from kumiki.functions import text as T
from kumiki.operators import bank as B
from kumiki.operators import compose, lookup, merge, quality, schedule, srs
from kumiki.operators.orphans import orphan_moments
from kumiki.sources import readers, writers
from kumiki.streaming import folds

D = dt.datetime


def greedy(rows):
    k_seen, l_seen, out = {}, {}, {}
    for r, k, lk in sorted(rows):
        s = k_seen.get(k) or l_seen.get(lk)
        if s:
            out[r] = (False, s)
        else:
            k_seen[k] = l_seen[lk] = r
            out[r] = (True, r)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_linkage_is_the_greedy_one(spark, seed):
    rnd = random.Random(seed)
    rows = [(i + 1, f"k{rnd.randrange(12)}", f"l{rnd.randrange(12)}") for i in range(60)]
    if seed == 0:
        rows = [(1, "k1", "l1"), (2, "k1", "l2"), (3, "k2", "l2")]
    got = B.linked(spark.createDataFrame(rows, "rank long, k string, lk string")).collect()
    assert {r["rank"]: (r["kept"], r["survivor"]) for r in got} == greedy(rows)


def test_linkage_of_nothing(spark):
    assert B.linked(spark.createDataFrame([], "rank long, k string, lk string")).count() == 0


def test_survivors_inherit_from_the_first_donor(spark):
    rows = [(1, "k", "a", None, ""), (2, "k", "b", "two", "x"), (3, "k", "c", "three", "y")]
    r = spark.createDataFrame(rows, "rank long, k string, lk string, explanation string, exam string")
    s = B.survivors(r, B.linked(r)).collect()
    assert [(x["rank"], x["explanation"], x["exam"], x["donors"]) for x in s] == [(1, "two", "x", 2)]


def card_of(events):
    box = reps = lapses = 0
    for ts, kind in events:
        if kind == "again":
            box, lapses, wait = 0, lapses + 1, 1
        elif kind == "hard":
            wait = 2
        else:
            box = min(5, box + (2 if kind == "easy" else 1))
            wait = [1, 3, 7, 14, 30, 60][box]
        reps += 1
        due = (ts + dt.timedelta(days=wait)).date()
    return box, due, reps, lapses


def test_card_fold(spark):
    rnd = random.Random(5)
    ev = [("u", k, D(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(900)), i, rnd.choice(["again", "hard", "good", "easy"])) for i, k in enumerate(rnd.choices(range(6), k=80))]
    got = srs.cards(spark.createDataFrame(ev, "u string, k int, ts timestamp_ntz, id long, kind string"), ["u", "k"]).collect()
    want = {k: card_of([(t, x) for _, kk, t, i, x in sorted(ev, key=lambda e: (e[2], e[3])) if kk == k]) for k in {e[1] for e in ev}}
    assert {r["k"]: (r["box"], r["due"], r["reps"], r["lapses"]) for r in got} == want


def test_card_edges(spark):
    def run(*kinds):
        ev = [("u", D(2024, 1, i + 1), i, k) for i, k in enumerate(kinds)]
        return srs.cards(spark.createDataFrame(ev, "u string, ts timestamp_ntz, id long, kind string"), ["u"]).collect()

    assert [(r.box, r.due, r.reps) for r in run("wrong")] == [(0, dt.date(2024, 1, 1), 0)]
    assert [(r.box, r.reps) for r in run("wrong", "wrong")] == [(0, 0)]  # a box 0 card stays as it is
    assert [(r.box, r.lapses) for r in run("good", "wrong")] == [(0, 1)]
    assert run("flag", "flag") == []
    assert [(r.box, r.flagged) for r in run("flag", "good", "flag")] == [(1, False)]
    assert [(r.box, r.due) for r in run("easy", "easy", "easy")] == [(5, dt.date(2024, 3, 3))]


def side(spark, rows):
    return spark.createDataFrame([(c, i, D(2024, 1, t), v) for c, i, t, v in rows], "coll string, id string, t timestamp_ntz, v string")


def test_merge_rules(spark):
    a = side(spark, [("srs", "1", 2, "a"), ("srs", "2", 3, "a"), ("srs", "3", 5, "a"), ("srs", "4", 5, "a")])
    b = side(spark, [("srs", "1", 2, "b"), ("srs", "2", 1, "b"), ("srs", "5", 1, "b")])
    dead = side(spark, [("srs", "3", 5, ""), ("srs", "4", 4, "")])
    got = {r.id: r.v for r in merge.last_writer(a, b, dead).collect()}
    assert got == {"1": "b", "2": "a", "4": "a", "5": "b"}
    again = merge.last_writer(merge.last_writer(a, b, dead), b, dead)
    assert merge.same_state(again, merge.last_writer(a, b, dead))
    now = F.lit(D(2024, 6, 29)).cast("timestamp_ntz")  # 180 days after January 1st
    t = side(spark, [("x", "old", 1, ""), ("x", "new", 2, "")]).drop("v")
    assert [r.id for r in merge.tombstones(t, t, now).collect()] == ["new"]
    assert {r.id for r in merge.fenced(a, F.lit(D(2024, 1, 3)).cast("timestamp_ntz")).collect()} == {"3", "4"}


def test_newer_epoch(spark):
    r = spark.sql("SELECT 'a' AS ai, 1 AS at, 'b' AS bi, 1 AS bt").select(merge.newer_epoch(*map(F.col, ("ai", "at", "bi", "bt")))).first()[0]
    assert r


INTERVALS = [("a", 1, 5), ("a", 3, None), ("b", 2, 2), ("b", 4, 9), ("b", 4, 9), ("c", None, 9), ("d", 1, 3), ("d", 3, 6), ("d", 40, None)]


@pytest.mark.parametrize("how", [{}, {"heavy_share": 0.9}, {"heavy_share": 0.01, "broadcast_rows": 0}])
def test_orphans_by_every_way(spark, how):
    day = lambda n: None if n is None else D(2024, 1, 1) + dt.timedelta(days=n)
    refs = [(k, day(t)) for k in "abcde" for t in [0, 1, 2, 3, 4, 5, 6, 9, 39, 40, 70, None]] + [("", day(1)), (None, day(1)), ("　", day(1))]
    t = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in INTERVALS], "key string, begin timestamp_ntz, end timestamp_ntz")
    r = spark.createDataFrame(refs, "key string, at timestamp_ntz")
    held = lambda k, t: t is not None and any(k == i and a is not None and day(a) <= t and (b is None or day(b) > t) for i, a, b in INTERVALS)
    want = {(k, t) for k, t in refs if k and k.strip() and not held(k, t)}
    got = orphan_moments(r, t, **how).collect()
    assert {(x.key, x.at) for x in got} == want and len(got) == len(want)


def test_validity_reasons(spark):
    base = {"options": ["a", "b"], "answer": 0, "section": "moji", "type": "context", "question": "q", "passage": None, "audio": None}
    cases = [
        ({}, None), ({"options": None}, "options"), ({"options": ["a", " "]}, "empty option"), ({"options": ["a", "すべて正しい"]}, "all of the above"),
        ({"answer": 2}, "answer"), ({"answer": None}, "answer"), ({"section": None}, "section"), ({"question": "　"}, "stem"),
        ({"type": "reading_mid"}, "passage"), ({"type": "listening", "section": "choukai"}, "audio"),
    ]
    rows = [tuple({**base, **c}.values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "options array<string>, answer int, section string, type string, question string, passage string, audio string")
    got = [r[0] for r in df.select(B.drop_reason(*map(F.col, ("options", "answer", "section", "type", "question", "passage", "audio")))).collect()]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize(
    "f,given,want",
    [
        (T.norm, "ＡＢＣ　「です」！", "abcです"), (T.fix_spacing, "あ い う a b", "あいう a b"), (T.clean_text, " a \r\n\r\n\r\n\r\nb\t\n", "a\n\nb"),
        (T.star_row, "＿ ＿ ＊ ＿", "＿＿＿ ＿＿＿ ＿★＿ ＿＿＿"), (T.star_row, "＿ ＿ ＿ ★ ＿ ＿ ＿ ＿ ＿", "＿＿＿ ＿★＿ ＿＿＿ ＿＿＿"), (T.star_row, "★ ★ ＿ ＿", "★ ★ ＿ ＿"),
        (T.slug, "Đề Thi N3 – 2010", "e-thi-n3-2010"), (T.plain, "{漢字|かんじ}と[[u:下線]]", "漢字と下線"), (T.strip_furigana, "漢字(かんじ)と言葉（ことば）", "漢字と言葉"),
        (T.inline_marks, "{{()}}と{{語}}と[x]と[]", "（　　）と＿語＿と＿x＿と＿＿＿"), (T.hiragana, "カタカナ", "かたかな"), (T.ascii_digits, "１２３", "123"),
        (T.ocr_newlines, "一行\n続き。\n次\n・点", "一行続き。\n次\n・点"), (T.senses, "1. a\n2. b\n3. a\n4. c\n5. d", "a; b; c"), (T.natural, "a2b10", "a000000000002b000000000010"),
        (markup.html_text, "<p>漢<rt>かん</rt></p><table><tr><td>a</td><td>b</td></tr></table>&amp;<script>x</script>", "漢\n\na | b\n\n&"),
    ],
)
def test_text_functions(spark, f, given, want):
    df = spark.createDataFrame([(given,), (None,)], "c string")
    got = [r[0] for r in df.select(f(F.col("c"))).collect()]
    assert got[0] == want and got[1] in (None, "")


def test_option_numbers(spark):
    df = spark.createDataFrame([(["1. a", "2. b", "3. c", "d"],), (["1 x", "b"],), ([],)], "o array<string>")
    assert [r[0] for r in df.select(T.strip_numbers(F.col("o"))).collect()] == [["a", "b", "c", "d"], ["1 x", "b"], []]


def test_transcript_and_completion(spark):
    df = spark.createDataFrame([(["1. a\n2. b", "長い文章です\n-------\n答え", None],)], "c array<string>")
    assert df.select(T.longest_transcript(F.col("c"))).first()[0] == "長い文章です"
    r = spark.createDataFrame([("grammar_form", "明日（　　）行く（　　）", "$1で", None, None)], "k string, s string, r string, p string, n string")
    assert r.select(T.completed(*map(F.col, "ksrpn"))).first()[0] == "明日$1で行く（　　）"


def test_markup_parsers():
    assert markup.grid("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["a", "c"]]
    assert markup.balanced('x = {"a": "}", "b": {}} y') == '{"a": "}", "b": {}}'
    assert markup.hydrate([{"a": 1, "b": 2}, "x", [1, 0]]) == {"a": "x", "b": ["x", None]}


def test_contained_patterns(spark):
    t = spark.createDataFrame([(1, "abcabc"), (2, "b"), (3, None), (4, "")], "id int, text string")
    p = spark.createDataFrame([("ab",), ("b",), ("abca",), ("x",), ("",)], "pattern string")
    assert sorted((r.id, r.pattern) for r in lookup.contained(t, p).collect()) == [(1, "ab"), (1, "abca"), (1, "b"), (2, "b")]


def test_batches_are_whole_and_in_order(spark):
    df = spark.createDataFrame([(f"{i:04d}", "ab"[i % 2]) for i in range(501)], "id string, s string")
    got = quality.batches(df, ["s"], [F.col("id")], 40).collect()
    assert len(got) == 501
    for s in "ab":
        ids = sorted(r.id for r in got if r.s == s)
        assert {r.id: r.batch for r in got if r.s == s} == {x: i // 40 + 1 for i, x in enumerate(ids)}


def test_schedule_of_five_units(spark):
    u = spark.createDataFrame([("t", str(i), i, True) for i in range(5)], "track string, unit string, pos long, ready boolean")
    got = schedule.activities(u).orderBy("seq").collect()
    assert [(r.week, r.slot, r.kind, r.units) for r in got][7:] == [(1, 0, "L", "4"), (1, 2, "P", "4"), (1, 6, "M", "4")]
    assert [r.practice for r in got if r.kind == "P"] == [1, 2, 3]


def test_estimates(spark):
    from kumiki.operators.attempts import estimates

    rows = [(1, s, i < n) for s, n in (("moji", 10), ("dokkai", 10), ("choukai", 3)) for i in range(10)] + [(2, "moji", True)]
    got = {r.session: (r.language, r.reading, r.listening, r.passed) for r in estimates(spark.createDataFrame(rows, "session int, section string, ok boolean")).collect()}
    assert got == {1: (60, 60, 18, False), 2: (60, None, None, False)}


def test_drill_strategies(spark):
    items = spark.createDataFrame([(f"q{i}", "context", False, None) for i in range(30)], "qid string, type string, suspect boolean, passage_id string")
    stats = spark.createDataFrame([(f"q{i}", 1, 0, 1) for i in range(3)], "qid string, n int, c int, w int")
    assert {r.qid for r in compose.drill(items, stats, "s", 3, "wrong").collect()} == {"q0", "q1", "q2"}
    assert not {"q0", "q1", "q2"} & {r.qid for r in compose.drill(items, stats, "s", 10, "unseen").collect()}
    assert compose.drill(items, stats, "s", 10).collect() == compose.drill(items, stats, "s", 10).collect()


def test_readers_and_writers(spark, tmp_path):
    q = {"id": "a:1", "source": "a", "question": "q", "options": ["x", "y"], "answer": 0}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/b.json").write_text(json.dumps([{**q, "id": "b:1", "source": "b"}]))
    (tmp_path / "raw/a.json").write_text(json.dumps([q]))
    (tmp_path / "raw/ref_x.json").write_text(json.dumps([q]))
    (tmp_path / "raw/empty.json").write_text("[]")
    got = readers.raw_files(spark, f"{tmp_path}/raw/*.json", tier_b=["a"]).orderBy("rank").collect()
    assert [r.id for r in got] == ["b:1", "a:1"]
    assert readers.or_empty(spark, f"{tmp_path}/none.json", "id string").count() == 0
    (tmp_path / "x1.json").write_text(json.dumps({"1": {"trans": "old"}}))
    (tmp_path / "x2.json").write_text(json.dumps({"1": {"trans": "new", "note": "n"}}))
    (tmp_path / "passages.json").write_text(json.dumps({"p": "v", "q": {"vi": "w"}}))
    assert [(r.id, r.trans) for r in readers.annotations(spark, f"{tmp_path}/*.json").collect()] == [("1", "new")]
    assert {r.pid: r.vi for r in readers.passage_translations(spark, f"{tmp_path}/*.json").collect()} == {"p": "v", "q": "w"}
    (tmp_path / "w.csv").write_text("word,reading,meaning,tags\n猫,ねこ,cat,\n猫,ねこ,feline,\nうち,,house,\n,x,y,\n")
    assert sorted((r.word, r.reading, r.meaning) for r in readers.word_list(spark, f"{tmp_path}/w.csv").collect()) == [("うち", "うち", "house"), ("猫", "ねこ", "cat")]
    (tmp_path / "p.html").write_bytes("日本".encode("cp932"))
    assert readers.pages(spark, f"{tmp_path}/p.html", "cp932").first().html == "日本"
    writers.bank(spark.createDataFrame([("1", "moji"), ("2", "bunpo")], "id string, section string"), f"{tmp_path}/bank")
    assert readers.bank_sections(spark, f"{tmp_path}/bank", ["moji"]).count() == 1
    assert writers.unpack(writers.pack("テスト" * 99)) == "テスト" * 99 and writers.unpack(writers.pack("x")) == "x"


def test_state_files(spark, tmp_path):
    state = {"version": 2, "app": "x", "stats": {"q": {"n": 1, "c": 1, "last": 5}}, "notes": {"q": "hi"}, "meta": {"noteAt": {"q": 9}}}
    (tmp_path / "s.json").write_text(json.dumps(state))
    s = readers.state(spark, f"{tmp_path}/s.json")
    assert sorted((r.coll, r.id, r.t) for r in readers.collections(s).collect()) == [("notes", "q", 9), ("stats", "q", 5)]
    (tmp_path / "bad.json").write_text(json.dumps({"version": 2}))
    with pytest.raises(Exception, match="no exported state"):
        readers.state(spark, f"{tmp_path}/bad.json").collect()


def test_reachable(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    got = readers.reachable(e, spark.createDataFrame([(1,)], "node int")).collect()
    assert {r.node: r.depth for r in got} == {1: 0, 2: 1, 3: 2}


def test_lockout_stream_equals_batch(spark, tmp_path):
    rows = [(1, D(2024, 1, 1, 0, m), m) for m in (0, 5, 10, 50, 55)] + [(2, D(2024, 1, 1), 9), (1, D(2024, 1, 5), 10)]
    df = spark.createDataFrame(rows, "key int, ts timestamp, id int")
    df.write.parquet(f"{tmp_path}/f")
    s = folds.source(spark, f"{tmp_path}/f", df.schema)
    got = folds.drained(folds.running_lockouts(s, "15 minutes", 3, "1 hour"), "append").collect()
    from kumiki.operators.attempts import lockouts

    want = lockouts(df, 900, 3).collect()
    assert [(r.key, r.fails) for r in got] == [(r.key, r.fails) for r in want] == [(1, 3)]


def card_of(events):
    box = reps = lapses = 0
    for ts, kind in events:
        box = 0 if kind == "again" else box if kind == "hard" else min(5, box + (2 if kind == "easy" else 1))
        wait = {"again": 1, "hard": 2}.get(kind) or [1, 3, 7, 14, 30, 60][box]
        reps, lapses = reps + 1, lapses + (kind == "again")
    return box, (ts + dt.timedelta(days=wait)).date(), reps, lapses


def test_card_stream_folds_batch_by_batch(spark, tmp_path):
    """60,000 cards at first, then five batches for some of them and new ones, against a plain fold; a Python call a card takes minutes."""
    rnd, rows, at = random.Random(5), [], D(2024, 1, 1)
    for n in range(6):
        for k in range(60_000) if n == 0 else rnd.sample(range(60_500), 400):
            for _ in range(1 if n == 0 else rnd.randrange(1, 4)):
                at += dt.timedelta(seconds=rnd.randrange(1, 9))
                rows.append((n, k % 7, k, at, len(rows), rnd.choice(["again", "hard", "good", "easy", "easy"])))
    schema = "n int, user_id long, k long, ts timestamp_ntz, id long, kind string"
    for n in range(6):
        part = pd.DataFrame([r for r in rows if r[0] == n], columns=["n", "user_id", "k", "ts", "id", "kind"])
        spark.createDataFrame(part.sample(frac=1, random_state=n), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
        time.sleep(1.1)  # files of one second have no order
    began = time.time()
    stream = folds.source(spark, f"{tmp_path}/f", spark.read.parquet(f"{tmp_path}/f").schema, 1)
    got = {(r.user_id, r.k): tuple(r)[2:] for r in folds.running_cards(stream).collect()}
    took, own = time.time() - began, {}
    for _, user, k, ts, _, kind in rows:
        own.setdefault((user, k), []).append((ts, kind))
    assert got == {key: card_of(e) for key, e in own.items()}
    assert took < 40


def test_card_stream_of_nothing(spark, tmp_path):
    (tmp_path / "f").mkdir()
    schema = spark.createDataFrame([], "user_id long, k long, ts timestamp_ntz, id long, kind string").schema
    assert folds.running_cards(folds.source(spark, f"{tmp_path}/f", schema)).count() == 0


def test_compare_and_set(spark, tmp_path):
    p = str(tmp_path / "row")
    assert folds.put_if(spark, p, 0, "a") == (True, 1) and folds.put_if(spark, p, 0, "b") == (False, 1)
    assert folds.synced(spark, p + "2", {"x": 1}, lambda a, b: {**b, **a}) == {"x": 1}
    assert folds.synced(spark, p + "2", {"y": 2}, lambda a, b: {**b, **a}) == {"x": 1, "y": 2}


def test_build_job(spark, tmp_path):
    from kumiki import jobs

    q = {"source": "a", "exam": "x", "section": "moji", "type": "context", "mondai": 3, "answer": 0, "level": "N3"}
    items = [{**q, "id": f"a:{i}", "question": f"stem number {i}", "options": ["x", "y", "z", "w"]} for i in range(12)]
    items += [{**q, "id": "a:dup", "question": "Stem number 3", "options": ["w", "z", "y", "x"], "answer": 3, "explanation": "kept"}, {**q, "id": "a:bad", "question": "", "options": ["x"]}]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.json").write_text(json.dumps(items))
    jobs.build(spark, f"{tmp_path}/raw/*.json", f"{tmp_path}/out", [], ["a"], [])
    bank = spark.read.parquet(f"{tmp_path}/out/bank")
    assert bank.count() == 12 and bank.where("id = 'a:3'").first().explanation == "kept"
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/aliases").collect()] == [("a:dup", "a:3")]
    assert spark.read.parquet(f"{tmp_path}/out/exams").first().total == 12
    m = {(r.kind, r.key): r.n for r in spark.read.json(f"{tmp_path}/out/manifest").collect()}
    assert m["total", None if ("total", None) in m else ""] == 12 and m["dropped", "options"] == 1
    (tmp_path / "done").mkdir()
    (tmp_path / "done/a.json").write_text(json.dumps({"a:0": {"trans": "t"}}))
    jobs.batches(spark, f"{tmp_path}/out/bank", f"{tmp_path}/done/*.json", f"{tmp_path}/batches", 5)
    got = spark.read.json(f"{tmp_path}/batches").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in got) == [1, 5, 5]
    assert jobs.validate(spark, f"{tmp_path}/out/bank") == 1


def test_paths_of_a_document():
    assert markup.walk({"a": [1, {"b": "x"}], "c": None, "d": True}) == [("$.a[0]", "1"), ("$.a[1].b", "x"), ("$.d", "true")]


def test_two_level_windows(spark):
    """Numbers, runs, carried and back-filled values equal a plain pass, with nulls, ties and a group of most rows."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, None, "p", "q"])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o long, passage_id string").repartition(7)
    by = {}
    for g, o, p in rows:
        by.setdefault(g, []).append((o, p))
    place = {(r.g, r.o): r.place for r in quality.numbered(df, ["g"], [F.col("o")]).collect()}
    forward = {r.o: r.passage_id for r in quality.carry_forward(df, "g", "o", "passage_id").collect()}
    back = {r.o: r.passage_id for r in quality.back_fill(df, ["g"], "o", "passage_id").collect()}
    sums = {r.o: r.s for r in quality.running(df, ["g"], [F.col("o")], "o", "s").collect()}
    items = sorted((r.g or "", r.item, r.pid, r.n, r.pos) for r in quality.passage_items(df, "g", ["o"]).collect())
    want = []
    for g, xs in by.items():
        seen, total, item, last = None, 0, 0, None
        for i, (o, p) in enumerate(sorted(xs)):
            seen, total = p if p is not None else seen, total + o
            assert place[g, o] == i + 1 and forward[o] == seen and sums[o] == total
            if p is None or p != last:
                item += 1
                want.append([g or "", item, p, 0, i + 1])
            want[-1][3] += 1
            last = p
        nxt = None
        for o, p in sorted(xs, reverse=True):
            nxt = p if p is not None else nxt
            assert back[o] == nxt
    assert items == sorted(map(tuple, want))
    near = {r.o: (r.before, r.after) for r in quality.neighbours(df.where("g IS NOT NULL"), "o", ["g"]).collect()}
    b = sorted(o for o, _ in by["b"])
    assert [near[o] for o in b] == [(x, y) for x, y in zip([None, *b], [*b[1:], None])]
    assert quality.numbered(df.where("false"), ["g"], [F.col("o")]).count() == 0


def test_classes_of_sources(spark):
    from kumiki.operators import classify as C

    def at(place):
        return tuple(spark.range(1).select(place.alias("x")).first().x)

    lit, opts = F.lit, lambda *x: F.array(*map(F.lit, x))
    none = lit(None).cast("string")
    assert at(C.by_label(lit("vocab"), lit("usage"), lit("a {{()}} b"))) == ("moji", 3, "context")
    assert at(C.by_label(lit("listening"), lit("quick_response"), none)) == ("choukai", 5, "listening")
    assert at(C.by_shape(lit("kanji"), lit("＿交換＿する"), opts("こうかん", "こかん"), False)) == ("moji", 1, "kanji_reading")
    assert at(C.by_shape(lit("kanji"), lit("＿交換＿する"), opts("swap", "ask"), True)) == ("moji", None, "kanji_meaning")
    assert at(C.by_instruction(lit("reading"), none, none, lit("x" * 351))) == ("dokkai", 5, "reading_mid")
    assert at(C.by_prefix(lit("問題１ -  Kanji   Reading"))) == ("moji", 1, "kanji_reading")
    assert at(C.by_map(lit("nghe hiểu tổng hợp"))) == ("choukai", None, "listening")
    assert at(C.by_group(lit("Vocab"), lit("相談"), opts("＿相談＿した", "＿相談＿な", "＿相談＿を", "x"))) == ("moji", 5, "usage")
    assert at(C.by_direction(lit("kanji_choice"), lit("kanji_to_reading"), none)) == ("moji", 1, "kanji_reading")
    assert at(C.by_header(lit("同じひらがなで書く 漢字"), lit("k"))) == ("moji", None, "orthography")
    assert at(C.by_content(none, lit("bunpo"), lit(3), lit(2), lit("a（　）b"))) == ("bunpo", 1, "grammar_form")
    assert at(C.by_block(lit("kanji"), none)) == ("moji", 2, "orthography")
    r = spark.range(1).select(C.recovered_options(opts("", "", ""), lit("男：x\n1. はい \n２．いいえ\n3) たぶん")).alias("a"), C.recovered_options(opts("", ""), none).alias("b")).first()
    assert r.a == ["はい", "いいえ", "たぶん"] and r.b == ["1", "2"]


def test_merged_tasks(spark):
    """Six groups of a grammar paper, the last one with six items on two passages: its last two items are of task 7."""
    from kumiki.operators import classify as C

    rows = [("e", "grammar", f"g{k}", 10 * k + i, "問題", f"p{i // 4}" if k == 5 else None) for k in range(6) for i in range(6 if k == 5 else 2)]
    df = spark.createDataFrame(rows, "exam string, paper string, g string, o long, ins string, passage string")
    got = {r.o: (r.place.type, r.odd) for r in C.by_position(df, "exam", "paper", "g", "o", "ins", "passage").collect()}
    assert [got[50 + i][0] for i in range(6)] == ["reading_long"] * 4 + ["info_retrieval"] * 2 and got[0] == ("grammar_form", True) and len(got) == 16


def test_inherited_annotations(spark):
    rows = [(1, "keep", ["x", "y"], None, None), (2, "gives", ["x", "y"], "e", "ex"), (3, "later", ["y", "x"], None, None)]
    r = spark.createDataFrame(rows, "rank long, id string, norm_options array<string>, explanation string, exam string")
    links = spark.createDataFrame([(1, True, 1), (2, False, 1), (3, False, 1)], "rank long, kept boolean, survivor long")
    schema = "id string, opts array<string>, trans string, note string"

    def out(*notes):
        x = B.survivors(r, links, spark.createDataFrame([*notes], schema)).first()
        return (x.explanation, x.exam, x.donors, x.ex and tuple(x.ex), x.suspect)

    assert out(("later", ["a", "b"], "t", "(?) sai")) == ("e", "ex", 2, (None, "t", "(?) sai"), True)
    assert out(("gives", ["a", "b"], "", None), ("later", None, "t", None)) == ("e", "ex", 2, (["a", "b"], None, None), False)
    assert out(("keep", None, "own", None), ("gives", None, "t", None)) == ("e", "ex", 2, (None, "own", None), False)
    assert out(("other", None, "t", None)) == ("e", "ex", 2, None, False)


def test_decks_and_quizzes(spark):
    points = spark.createDataFrame([(1, "g", 5, 0, 0), (2, "g", 3, 12, 1), (3, "h", 9, 2, 4)], "id long, grp string, n long, exams long, examples long")
    cards = spark.createDataFrame([(1, 0, "2024-01-02", 3, 2), (2, 5, "2024-01-01", 9, 1)], "id long, box int, due string, reps int, lapses int").withColumn("due", F.to_date("due"))
    day = F.lit("2024-01-02").cast("date")

    def deck(mode, **how):
        return [r.id for r in compose.deck(points, cards, mode, day, **how).orderBy("place").collect()]

    assert deck("due") == [2, 1] and deck("new") == [3] and deck("weak") == [1] and sorted(deck("all", seed="s")) == [1, 2, 3] and len(deck("all", seed="s", limit=2)) == 2 and deck("due", group="g", limit=1) == [2]
    assert deck("new", official=True) == [3] and compose.deck(points.where("false"), cards, "due", day).count() == 0
    kinds = {s: {r.id: r.kind for r in compose.quiz(points, cards, s, "q").collect()} for s in ("all", "weak", "freq")}
    assert set(kinds["all"]) == {1, 2, 3} and set(kinds["weak"]) == {1, 3} and set(kinds["freq"]) == {2} and kinds["all"][1] in ("p2m", "m2p")


def test_import_modes(spark):
    a, b = side(spark, [("srs", "1", 5, "a"), ("srs", "2", 1, "a")]), side(spark, [("srs", "1", 2, "b"), ("srs", "3", 1, "b")])
    dead = side(spark, []).select("coll", "id", "t")

    def rows(mode):
        return {r.id: r.v for r in merge.imported(a, b, dead, mode).collect()}

    assert rows("merge") == {"1": "a", "2": "a", "3": "b"} and rows("replace") == {"1": "b", "3": "b"} and rows("reset") == {}
    assert merge.new_epoch("merge", ("a", 1), ("b", 2)) == ("a", 1) and merge.new_epoch("reset", ("a", 1), ("b", 2)) == ("b", 2)
    both = merge.merged(a, b, dead, ("a", D(2024, 1, 1)), ("b", D(2024, 1, 3)))
    assert {r.id: r.v for r in both.collect()} == {"1": "a", "3": "b"}


def test_table_structure_and_payloads():
    M = markup

    page = "<table class=usage><tr><td>V</td><td rowspan=2>ことだ</td></tr><tr><td>N</td></tr><tr><td>A</td></tr></table>"
    assert M.structure(page) == "V + ことだ / N + ことだ / A" and M.structure("no table") is None
    assert M.hydrate([["Reactive", 1], {"a": 2, "b": 3, "c": 0, "d": "x"}, "v", ["Set", 2, True, "y"]]) == {"a": "v", "b": ["v", True, "y"], "c": None, "d": "x"}
    assert M.hydrate([]) is None and M.hydrate([["Ref"]]) is None
    assert M.flight('<script>f.push([1,"a\\"b"])</script>f.push([0])<script>f.push([1, "c"])</script>') == 'a"bc' and M.flight("") is None

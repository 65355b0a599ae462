"""The operators for training data against brute force, round trips and hand-made cases, with nulls, blanks, ties and empty tables."""

import datetime as dt
import json
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from kumiki.llm import catalog, copies, encode, fold, neardup, packing, pairs, survivors, topics, visual

D = dt.datetime
VOCABULARY = os.path.join(encode.FOLDER, f"{encode.TOKENIZER}.json")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == duck_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, data, name):
    if name.startswith(("p7", "p8")) and not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary files")
    assert catalog.QUERIES[name](spark, data).count() >= 0


# copies


def test_fold():
    assert fold.folded(" Ａ-b　Ｃ。1​") == "ａbｃ1"
    assert fold.same("A b。", "ab") and not fold.same("ab", "abc") and fold.same(None, " 。")
    h = fold.hashes(["A b", "ab", None, "", "ba", "x" * 5000 + "y"])
    assert h[0][0] == h[0][1] != h[0][4] and h[0][2] == h[0][3] and list(h[2]) == [2, 2, 0, 0, 2, 5001]


def test_long_texts_hash_in_slices(monkeypatch):
    whole = fold.hashes(["abc def " * 50])
    monkeypatch.setattr(fold, "SLICE", 7)
    assert [list(x) for x in fold.hashes(["abc def " * 50])] == [list(x) for x in whole]


ROWS = [
    (1, "Q one", ["a", "b"]), (2, "q-ONE", ["B ", "a"]), (3, "q one", ["a", "c"]), (4, None, None), (5, "", []), (6, "。", None), (7, "q one", ["b", "a"]), (8, "q one", ["a", "a", "b"]), (9, "q two", None),
]


@pytest.mark.parametrize("how", [{}, {"bits": 1}, {"bits": 0}, {"hot_least": 1, "hot_share": 0.01}, {"bits": 1, "hot_least": 1, "hot_share": 0.01}])
def test_copies(spark, how):
    df = spark.createDataFrame(ROWS, "rid long, question string, options array<string>").withColumn("first", F.lit("clash"))
    got = copies.copy_pairs(df, ["question", "options"], ("options",), **how).collect()
    assert sorted((r.rid_a, r.rid_b) for r in got) == [(1, 2), (1, 7), (4, 5), (4, 6)]
    kept = copies.collapsed(df, copies.copy_pairs(df, ["question", "options"], ("options",), **how)).collect()
    assert {r.rid: r.copies for r in kept} == {1: 3, 3: 1, 4: 3, 8: 1, 9: 1}


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([], "rid long, question string")
    assert copies.copy_pairs(df, ["question"]).count() == 0


# survivors


def survivor_rows(spark, rows):
    full = [(i, "p", "q", ["a"], s, e, t, D(2024, 1, day)) for i, s, e, t, day in rows]
    return spark.createDataFrame(full, "rid long, passage string, question string, options array<string>, source string, explanation string, transcript string, crawled_at timestamp_ntz")


def test_best_rows(spark):
    trust = spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust int")
    keys = (["passage", "question", "options"], ("options",))
    win = survivor_rows(spark, [(1, "b", "short", None, 1), (2, "a", "longer text", "x", 2), (3, "a", "(trống)", None, 2)])
    assert [tuple(r) for r in survivors.best_rows(win, trust, *keys).collect()] == [(1, 2)]
    none = survivor_rows(spark, [(1, "a", "longer text", None, 1), (2, "b", "short", None, 2)])
    assert survivors.best_rows(none, trust, *keys).count() == 0
    filler = survivor_rows(spark, [(1, "a", "N/A none", None, 2), (2, "b", "-", None, 1)])
    assert [tuple(r) for r in survivors.best_rows(filler, trust, *keys).collect()] == [(1, 1)]
    tie = survivor_rows(spark, [(5, "a", "same", None, 2), (4, "a", "same", None, 2), (6, None, None, None, 1)])
    assert [tuple(r) for r in survivors.best_rows(tie, trust, *keys).collect()] == [(4, 4)]
    f = survivors.fused(win, trust, *keys).collect()
    assert [(r.group_rid, r.explanation, r.transcript, r.sources, r.rows) for r in f] == [(1, "longer text", "x", ["a", "b"], 3)]


def test_true_values_survive_many_silent_sources(spark):
    rows = [(k, f"s{k}", "one value of many" if k else "another value", None, 1) for k in range(12)]
    z = survivors.judged(survivor_rows(spark, rows), copies.copy_pairs(survivor_rows(spark, rows), ["question"])).select("z_explanation").collect()
    assert len(z) == 12 and all(r[0] > 0.5 for r in z)


def judged_many(spark, rows):
    """z and n of the explanations of (question, source, explanation), by rid."""
    full = [(i, "p", q, ["a"], s, e, None, D(2024, 1, 1)) for i, (q, s, e) in enumerate(rows)]
    df = spark.createDataFrame(full, "rid long, passage string, question string, options array<string>, source string, explanation string, transcript string, crawled_at timestamp_ntz")
    df = df.repartition(4)
    return {r.rid: r for r in survivors.judged(df, copies.copy_pairs(df, ["passage", "question", "options"], ("options",))).select("rid", "z_explanation", "n_explanation").collect()}


def test_fillers_elsewhere_leave_values_true(spark):
    """Thousands of fillers of every source beside a hot group whose sources all give all of its wordings."""
    sources = [f"s{k}" for k in range(6)]
    hot = [("hot", s, f"wording number {w}") for s in sources for w in "abcd"]
    fill = [(f"q{i}", s, "N/A" if s in (sources[i % 6], sources[(i + 1) % 6]) else "trống") for i in range(900) for s in sources[i % 3 :: 3] + [sources[(i + 1) % 6]]]
    some = [("two", "s0", "one wording"), ("two", "s1", "another wording"), ("two", "s2", "none")]
    got = judged_many(spark, hot + some + fill)
    assert all(got[i].z_explanation > 0.5 and got[i].n_explanation > 0 for i in range(len(hot) + 2))
    assert all(got[i].z_explanation < 1e-6 and got[i].n_explanation == 0 for i in range(len(hot) + 2, len(got))) and len(got) > 2500


def test_empty_talk_of_all_trusted_sources_stays_false(spark):
    sources = [f"s{k}" for k in range(12)]
    got = judged_many(spark, [("filler", s, "N/A") for s in sources] + [(f"q{i}", s, "the same value") for i in range(100) for s in sources])
    assert all((r.z_explanation < 0.5) == (rid < 12) for rid, r in got.items()) and len(got) == 1212


def test_one_doubtful_source_against_many_trusted_ones(spark):
    sources = [f"s{k}" for k in range(12)]
    rows = [("two", "s0", "the longer value of a doubtful source")] + [("two", s, "a value") for s in sources[1:]]
    rows += [(f"q{i}", s, "N/A" if s == "s0" else "the same value") for i in range(200) for s in sources]
    got = judged_many(spark, rows)
    assert all(got[i].z_explanation > 0.5 for i in range(12)) and got[12].n_explanation == 0


def test_unlisted_empty_talk_of_a_doubtful_source_counts_as_nothing(spark):
    """The same wording of several groups: the rates of the sources that say it decide, not its letters."""
    other = lambda i: [(f"q{i}", "s1", f"an explanation of {i}"), (f"q{i}", "s2", f"in other words {i}")]
    long = "more about this can be read here soon, please come back to this page"
    rows = [x for i in range(40) for x in [(f"q{i}", "s0", long), *other(i)]]
    often = rows + [x for i in range(40, 240) for x in [(f"q{i}", "s0", "N/A"), *other(i)]]
    never = rows + [x for i in range(40, 240) for x in [(f"q{i}", "s0", f"what s0 says of {i}"), *other(i)]]
    shared = [(q, "s1" if e == long else s, e) for q, s, e in often]
    for given, n in ((often, False), (never, True), (shared, True)):
        got = judged_many(spark, given)
        assert all((got[i].n_explanation > 0) == (n if e == long else e != "N/A") for i, (_, _, e) in enumerate(given)) and len(got) == len(given)


# near-duplicates


def brute_pairs(rows, t=neardup.SHARE, least=neardup.LEAST_LETTERS):
    g = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    j = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    texts = {r: tuple(fold.folded(x) for x in (p, q)) for r, p, q in rows}
    ok = [r for r in texts if sum(map(len, texts[r])) >= least]
    return {(a, b) for a in ok for b in ok if a < b and texts[a] != texts[b] and all(j(g(x), g(y)) >= t - 1e-12 for x, y in zip(texts[a], texts[b]))}


def edited_rows(seed, n=70):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(3, 7))) for _ in range(60)]
    base = [" ".join(rnd.choices(words, k=40)) for _ in range(8)]
    out = []
    for i in range(n):
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        passage = " ".join(w)
        q = rnd.choice(["what is the main point of this", "what is the main point of it", "who wrote this", "", None, "ab", "cd"])
        out.append((i, passage if rnd.random() < 0.7 else None, q if rnd.random() < 0.6 else " ".join(w[:35])))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 3), (4, 1)])
def test_versions_equal_brute_force(spark, seed, hot):
    rows = edited_rows(seed)
    df = spark.createDataFrame(rows, "rid long, passage string, question string").withColumn("text", F.lit("clash"))
    p, m = neardup.versions(df, hot=hot, least=60)
    got = [(r.rid_a, r.rid_b) for r in neardup.row_pairs(p, m).collect()]
    want = brute_pairs(rows, least=60)
    assert want and set(got) == want and len(got) == len(want)


def test_the_product_enumerates_only_what_positions_allow(monkeypatch):
    """Texts of a fixed vocabulary: the entries that reach the bit maps are few beside the pairs that share a prefix n-gram."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(300)]
    texts = ["".join(rnd.choices(words, k=30)) for _ in range(600)]
    texts += [x[:-10] + "".join(rnd.choices(words, k=2)) for x in texts[:50]]
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "tag": [0] * len(texts), "text": texts})
    f = np.zeros(neardup.BUCKETS, np.int64)
    for b in neardup._frequencies(iter([rows])):
        f[b.column("bucket").to_numpy()] += b.column("n").to_numpy()
    cells = list(neardup._prefixes(f, 0.65, 4096, 1)(iter([rows])))
    cell = np.concatenate([b.column("cells").flatten().to_numpy() for b in cells])
    shared = sum(k * (k - 1) // 2 for k in np.unique(cell, return_counts=True)[1])
    repeat, made = np.repeat, []
    monkeypatch.setattr(neardup.np, "repeat", lambda x, k: made.append(len(y := repeat(x, k))) or y)
    got = {tuple(x) for b in neardup._product(0.65)(iter(cells)) for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist())}
    g = [set(neardup.grams(x).tolist()) for x in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if len(g[i] & g[j]) >= 0.65 * len(g[i] | g[j])}
    assert want and want <= got
    assert sum(made[1:]) < 1.5 * shared  # three arrays of them; the first is the rows of the entries


def test_versions_of_nothing(spark):
    p, m = neardup.versions(spark.createDataFrame([(1, None, None)], "rid long, passage string, question string"))
    assert p.count() == 0 and m.count() == 0


def test_groups_have_a_row_for_each_row(spark):
    rows = edited_rows(7)
    rows += [(9001, None, None), (9002, "short", "text"), (9003, "x" * 40 + "the same long text " * 9, "question"), (9004, "X" * 40 + "the same long text! " * 9, "question")]
    df = spark.createDataFrame(rows, "rid long, passage string, question string")
    got = {r.rid: (r.group_rid, r.links) for r in neardup.groups(df, least=60).collect()}
    p, m = neardup.versions(df, least=60)
    cls = {r.rid: r.cls for r in m.collect()}
    edges = [tuple(r) for r in p.collect()]
    root = {r.node: r.root for r in neardup.components(p).collect()}
    assert len(got) == len(rows)
    for rid, *_ in rows:
        c = cls.get(rid, rid)
        assert got[rid] == (root.get(c, c), sum(c in e for e in edges))
    assert got[9001] == (9001, 0) and got[9002] == (9002, 0) and got[9003] == got[9004] == (9003, 0)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + a, 100 + b) for a, b in (rnd.sample(range(60), 2) for _ in range(50))]
    edges = [(min(e), max(e)) for e in edges]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame(edges, "class_a long, class_b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for e in edges for x in e}
    assert neardup.components(spark.createDataFrame([], "class_a long, class_b long")).count() == 0


# look-alikes


def test_look_alikes(spark):
    common = ["新しいパソコンとセンターとスーパーのロビー", "Wi-Fi と PC と DVD と cheering", "一人で北口へ行く。夕方の二人", "「спасибо」と言う", "Nghĩa của từ", "タクシー"]
    odd = {
        "文化セン夕ー": "文化センター", "ス一パー": "スーパー", "ロビ−": "ロビー", "PСと": "PCと", "ｶﾞｲﾄﾞ": "ガイド", "が": "が", "a b": "a b", "x​y": "xy", "⽇本": "日本", "ＡＢ": "AB", "𝐏C": "PC",
    }
    fine = ["北口へ", "二人は一人で", "「спасибо」", "（　　）＿★：？、。・", "Nghĩa của từ", "カ月", "夕方、", "", " ", "\t\n", "，．！"]
    rows = [(i, t, [t], None) for i, t in enumerate(common * 30 + list(odd) + fine)]
    df = spark.createDataFrame(rows, "rid long, question string, options array<string>, passage string")
    got = {r.question_old: (r.question, r.affected) for r in visual.normalized(df.withColumn("question_old", F.col("question")), ["question", "options", "passage"], ("options",)).collect()}
    for t, want in odd.items():
        assert got[t] == (want, ["question", "options"]), t
    for t in fine:
        assert got[t] == (t, []), t


def test_look_alikes_of_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", [None, ""])], "rid long, question string, options array<string>")
    got = visual.normalized(df, ["question", "options"], ("options",)).orderBy("rid").collect()
    assert [(r.question, r.options, r.affected) for r in got] == [(None, None, []), ("", [None, ""], [])]


# pairs


@pytest.mark.parametrize(
    "text,broken",
    [("Xong.", False), ("Anh nói (rồi", True), ("「あ」 rồi", False), ("「あ", True), ("Anh đi,", True), ("a ...", True), ("```x", True), ("```x```", False), ("<b>x", True), ("<b>x</b><br>", False), ("1. a / 2. b / 3.", True), ('Nói "vậy" rồi', False), ("a <", True)],
)
def test_pushdown_parser(text, broken):
    assert pairs.broken(text) == broken


def test_tiles():
    assert pairs.tiles("abcdefghij", "xxabcdefyyghij") == 6
    assert pairs.tiles("abcabcabc", "abcabcabc", 3) == 9 and pairs.tiles("", "abc") == 0


def plain_tiles(text, source, least):
    used, taken, total = set(), set(), 0
    for k in range(min(len(text), len(source)), least - 1, -1):
        for i in range(len(text) - k + 1):
            for j in range(len(source) - k + 1):
                if text[i : i + k] == source[j : j + k] and not used & set(range(i, i + k)) and not taken & set(range(j, j + k)):
                    used |= set(range(i, i + k))
                    taken |= set(range(j, j + k))
                    total += k
    return total


def test_tiles_equal_a_plain_search():
    rnd = random.Random(5)
    for _ in range(150):
        a, b = ("".join(rnd.choice("abc"[: rnd.choice([1, 2, 3])]) for _ in range(rnd.randrange(1, 30))) for _ in range(2))
        if min(len(a), len(b)) >= 3:
            assert pairs.tiles(a, b, 3) == plain_tiles(a, b, 3)


def test_edited_copies_of_long_repetitive_questions():
    rnd = random.Random(6)
    q = "".join(rnd.choice("ab") for _ in range(4000))
    assert pairs.tiles(q[-600:], q) == 600
    t = list(q)
    for i in range(100, 4000, 200):
        t[i] = "c"
    assert pairs.copied("".join(t), q, [])


@pytest.mark.parametrize(
    "text,defect",
    [
        (None, "empty"), (" ", "empty"), ("(trống)", "empty"), ("TODO", "empty"), ("Dịch:", "empty"),
        ("Rất tiếc, tôi không thể dịch câu này.", "refusal"), ("I'm sorry, but I can't help with this item.", "refusal"), ("この内容については回答を控えさせていただきます。", "refusal"),
        ("駅の前で友だちを待っています。 → 待つ", "copy"), ("Dịch: 駅の前で友だちを待っています", "copy"),
        ("He waits for a friend in front of the station.", "language"), ("友だちは来なかったと聞きました。残念です。", "language"), ("Nach 3 Tagen hat er die Unterlagen zurückgegeben.", "language"),
        ("Tôi đang đợi bạn ở 「駅", "truncated"), ("Tôi đang đợi bạn trước ga và", "truncated"),
        ("Tôi đang đợi bạn trước ga.", None), ("Người nói xin lỗi nên ý 3 không hợp.", None), ("Tôi tưởng chỉ cần vé, nhưng nhận ra tiền cũng không thể thiếu.", None), ("Câu đúng: 友だちは来なかったと聞きました。", None),
    ],
)
def test_defects_of_a_text(text, defect):
    assert pairs.judge(text, "駅の前で友だちを待っています。", ["待つ", "来る"], True) == defect


@pytest.mark.parametrize(
    "text,declines",
    [("Tôi xin lỗi, tôi không thể dịch câu này.", True), ("Xin lỗi, tôi đến muộn.", False), ("Với tư cách là một giáo viên, anh ấy nói", False), ("Với tư cách là một trợ lý, tôi", True),
     ("I'm sorry, but I can't help with that.", True), ("I am sorry I was late.", False), ("As an AI language model, I cannot", True), ("Anh ấy không thể dịch", False),
     ("Việc này nằm ngoài khả năng của tôi", True), ("Không thể hỗ trợ yêu cầu này", True), ("申し訳ありませんが、お答えできません", True), ("Leider kann ich nicht helfen", True), ("", False)],
)
def test_refusal_grammar(text, declines):
    assert pairs.refuses(text) == declines


def test_fillers_of_any_length():
    assert survivors.says_nothing("N/A " * 500) and not survivors.says_nothing("N/A " * 500 + "x") and survivors.says_nothing("。。。")


def test_long_padding_is_no_copy():
    q = "".join(chr(0x4E00 + i) for i in range(60))
    assert pairs.copied(q, q, []) and not pairs.copied(q + "đ" * 600, q, []) and pairs.coverable(q, q[:30] + "x" + q[30:]) == 60


def test_defects(spark):
    a = [(1, "x", "Tôi đang đợi bạn.", None), (2, "y", "Tôi đang đợi bạn.", "-"), (3, None, None, "駅で待つ"), (4, "x", "Tôi đang đợi b", None)] + [(10 + i, "x", "Tôi đang đợi bạn ở ga.", None) for i in range(9)]
    p = [("x", "駅で待つ", ["a"], D(2024, 1, 1)), ("x", "駅で待つ。", ["a"], None), (None, "z", None, None)]
    got = pairs.defects(spark.createDataFrame(a, "oid long, id string, trans string, note string"), spark.createDataFrame(p, "id string, question string, options array<string>, built_at timestamp_ntz")).collect()
    assert {r.oid: r.defect for r in got} == {3: "empty", 4: "truncated"}


# encoding and packing

ODD_TEXTS = ["", " ", "a", "hello world", "it's  we'll\n\n x", "日本語のテキスト。", "đã đến", "a" * 3000, "\x00<|endoftext|>", "👩‍👩‍👧 ﷽", "たこ" * 400, "mixed かな and Latin 123,456!", "　  x"]


@needs_vocabulary
@pytest.mark.parametrize("rows", [encode.ROWS, 64])
def test_encoding_equals_the_library(rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    e = encode.Encoder(VOCABULARY, rows)
    texts = ODD_TEXTS if rows > 64 else [x[:40] for x in ODD_TEXTS]
    got = [np.frombuffer(x, np.int32).tolist() for x in e.batch([None, *texts])]
    assert got == [[], *(x.ids for x in t.encode_batch(texts, add_special_tokens=False))]


@needs_vocabulary
def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, r.ids) for r in encode.encoded(df).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1] == []


@pytest.mark.parametrize("group_tokens,documents", [(10**9, 512), (20_000, 512), (20_000, 5)])
def test_packing(spark, group_tokens, documents):
    rnd = random.Random(1)
    sizes = [(i, int(rnd.paretovariate(1.1) * 40)) for i in range(1500)] + [(5000, 0), (5001, None), (5002, 2048), (5003, 4096), (5004, 5000)]
    df = spark.createDataFrame(sizes, "doc_id long, n long")
    got = packing.packed(df, documents=documents, group_tokens=group_tokens).collect()
    load, docs, parts = {}, {}, {}
    for r in got:
        if r.container is not None:
            load[r.container] = load.get(r.container, 0) + r.n
            docs[r.container] = docs.get(r.container, 0) + 1
        parts.setdefault(r.doc_id, []).append((r.start, r.n))
    assert max(load.values()) <= 2048 and max(docs.values()) <= documents
    for i, n in sizes:
        p = sorted(parts[i])
        assert sum(x for _, x in p) == (n or 0) and [a for a, _ in p] == [k * 2048 for k in range(len(p))]
        assert len(p) == max(1, -(-(n or 0) // 2048))
    if documents > 5:
        assert len(load) <= 1.03 * sum(n or 0 for _, n in sizes) / 2048 + 2


def test_packing_with_a_binding_attention(spark):
    """Texts above half the capacity are split, as their square alone would be too much; no container is over any capacity."""
    rnd = random.Random(2)
    sizes = [(i, rnd.randrange(1, 1500)) for i in range(400)] + [(1000, 1024), (1001, 1025), (1002, 5000)]
    got = packing.packed(spark.createDataFrame(sizes, "doc_id long, n long"), attention=1024**2, group_tokens=30_000).collect()
    load, parts = {}, {}
    for r in got:
        load.setdefault(r.container, []).append(r.n)
        parts.setdefault(r.doc_id, []).append((r.start, r.n))
    assert all(sum(x) <= 2048 and sum(n * n for n in x) <= 1024**2 for x in load.values()) and any(len(x) > 1 for x in load.values())
    for i, n in sizes:
        p = sorted(parts[i])
        assert sum(x for _, x in p) == n and [a for a, _ in p] == [k * 1024 for k in range(len(p))] and len(p) == -(-n // 1024)


@pytest.mark.parametrize("documents,attention", [(512, 2048**2), (20, 2048**2), (40, 300_000)])
def test_best_fit_takes_the_least_norm(documents, attention):
    rnd = random.Random(documents)
    sizes = sorted((min(500, int(rnd.paretovariate(0.6) * 5)) for _ in range(1200)), reverse=True)
    w = packing.WEIGHTS
    room = {}
    for n, c in zip(sizes, packing.best_fit(sizes, 2048, documents, attention)):
        norms = {
            k: (w[0] * (t - n) / 2048) ** 2 + (w[1] * (d - 1) / documents) ** 2 + (w[2] * (a - n * n) / attention) ** 2
            for k, (t, d, a) in room.items() if t >= n and d and a >= n * n
        }
        assert c not in room if not norms else norms[c] <= min(norms.values()) + 1e-12
        t, d, a = room.get(c, (2048, documents, attention))
        room[c] = (t - n, d - 1, a - n * n)


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, n long")).count() == 0
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([], "doc_id long, n long"), documents=0)


# subjects


def test_subjects_of_held_out_documents(spark):
    rnd = random.Random(3)
    terms = {"law": "court judge contract appeal verdict lawsuit".split(), "music": "piano choir melody rhythm concert violin".split(), "sport": "goal league referee coach medal marathon".split()}
    docs, truth = [], {}
    for i in range(400):
        s = rnd.choice([*terms, None])
        own = rnd.randrange(4, 8) if s else 0
        sents = [f"Many people talk about the {rnd.choice(terms[s])} and the {rnd.choice(terms[s])} today" for _ in range(own)]
        sents += [f"The {rnd.choice(['shop', 'bus', 'rain', 'phone'])} was late on {rnd.choice(['Monday', 'Friday'])} again" for _ in range(3)]
        rnd.shuffle(sents)
        docs.append((i, ". ".join(sents) + "."))
        truth[i] = s
    docs += [(1000, None), (1001, ""), (1002, " ")]
    labels = [(i, truth[i]) for i in range(0, 400, 5) if truth[i]] + [(3, "unknown"), (None, "law")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("labels", F.lit(1))
    got = {}
    for r in topics.subject_areas(df, spark.createDataFrame(labels, "doc_id long, subject string"), sorted(terms)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == ({truth[i]} if truth[i] else set()) for i in truth)
    assert right >= 0.95 * len(truth) and not {1000, 1001, 1002} & set(got)


def topic_features(spark, docs):
    """Features of (doc_id, text, labels), and all of their blocks."""
    df = spark.createDataFrame(docs, "doc_id long, text string, labels array<int>").repartition(2)
    f = df.mapInArrow(topics._features, "ids array<long>, labels array<array<int>>, per array<int>, body binary").cache()
    return f, list(topics._blocks(iter(f.toArrow().to_batches())))


def mixed_documents(n=300):
    """Documents of several of 6 subjects, whose words overlap, and a label on a few."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [[rnd.choice(letters) + letters[k] + rnd.choice(letters) * 2 + letters[j % 26] for j in range(60)] for k in range(6)]
    docs = []
    for i in range(n):
        ks = rnd.sample(range(6), rnd.choice([1, 2, 3]))
        sents = [" ".join(rnd.choice(words[rnd.choice([k, k, (k + 1) % 6])]) for _ in range(5)) for k in ks for _ in range(3)]
        docs.append((i, ". ".join(sents), [ks[0]] if i % 30 == 0 else None))
    return docs


@pytest.fixture(scope="module")
def topic_space(spark):
    f, blocks = topic_features(spark, mixed_documents())
    weight = np.zeros(topics.BUCKETS)
    weight[np.unique(np.concatenate([x.term for x in blocks]))] = 1.0
    return f, blocks, topics.Weighing(weight, 12)


def test_a_space_settles_on_the_leading_singular_vectors(topic_space, monkeypatch):
    f, blocks, w = topic_space
    rows = []
    for x in blocks:
        at, sentence = w.entries(x)
        a = np.zeros((x.n, len(w.weight)))
        np.add.at(a, (x.doc[sentence], at), 1.0)
        rows.append(a / np.sqrt(np.maximum(a.sum(1, keepdims=True), 1e-12)))
    best = np.linalg.svd(np.concatenate(rows), compute_uv=False)[:4]
    for first in (1, 20):
        monkeypatch.setattr(topics, "START", first)
        topics._space(f, w)
        assert np.allclose(w.vectors.T @ w.vectors, np.eye(12), atol=1e-3)  # all weights are 1
        got = np.linalg.svd(np.concatenate(rows) @ w.vectors, compute_uv=False)[:4]
        assert (got > 0.99 * best).all()
        z = sum(a.T @ (a @ w.vectors) for a in rows)
        assert topics.Iteration(w.vectors).advance(z)  # one more pass leaves the subspace as it is


def test_centroids_move_until_few_sentences_change(topic_space):
    f, blocks, w = topic_space
    topics._space(f, w)
    c = topics._centroids(f, w, lambda x: (x.labelled(), x.labelled().targets(6)[x.labelled().doc]), 6)
    sums, near = np.zeros_like(c, dtype=np.float64), []
    for x in blocks:
        e, _ = topics._embedded(x, w)
        k, ok, *_ = topics._assigned(x, w, c)
        topics._rows(sums, k[ok], e[ok].astype(np.float64))
        near.append(np.where(ok, k, -1))
    moved = topics._unit(sums + 0.01 * c)
    changed = sum((np.where(ok, k, -1) != old).sum() for (k, ok, *_), old in zip((topics._assigned(x, w, moved) for x in blocks), near))
    assert changed <= 0.005 * sum(map(len, near))


def test_labelled_part_of_a_block(topic_space):
    _, blocks, _ = topic_space
    for x in blocks:
        y = x.labelled()
        on = [bool(k) for k in x.labels]
        assert y.n == sum(on) and y.sentences == x.per[on].sum() and y.ids == [i for i, k in zip(x.ids, on) if k]
        want = [x.term[x.doc[x.sentence] == d].tolist() for d in np.flatnonzero(on)]
        assert [y.term[y.doc[y.sentence] == d].tolist() for d in range(y.n)] == want and (np.diff(y.sentence) >= 0).all()


def test_sentences_of_texts():
    """Terms, sizes and scripts of sentences against a plain reading, one sentence at a time."""
    texts = ["a b. c d e!", None, "", "漢字テストです。<b>x</b> ơi là", "...", "ａｂ １．５ cd\x00\x01ef", "one"]
    per, sizes, kinds, terms = topics.Terms().sentences(texts)
    assert per.tolist() == [2, 0, 0, 3, 0, 1, 1] and sizes.tolist() == [3, 5, 3, 1, 3, 5, 1] and kinds.tolist() == [2, 2, 0, 2, 1, 2, 2]
    alone = [t for x in texts if x for t in topics.Terms().sentences([x])[3].tolist()]
    assert terms.tolist() == alone and terms.min() >= 0 and terms.max() < topics.BUCKETS


def test_niche_words_decide_at_every_size(spark):
    niche = {"law": "flumen ordax vintel", "music": "sorbet kalimba trovan"}
    docs, labels = [], []
    for k, (s, w) in enumerate(niche.items()):
        docs += [(10 * k, f"{w}. {w}. {w}."), (10 * k + 1, f"{w}. {w}.")]
        labels.append((10 * k, s))
    docs += [(100 + i, f"the {'shop bus rain phone'.split()[i % 4]} was late. " * 1000) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = topics.subject_areas(df, spark.createDataFrame(labels, "doc_id long, subject string"), sorted(niche)).collect()
    assert {(r.doc_id, r.subject) for r in got if r.doc_id < 100} == {(0, "law"), (1, "law"), (10, "music"), (11, "music")}


def test_sums_and_products_of_blocks_equal_plain_ones(monkeypatch):
    rnd = np.random.default_rng(4)
    table = rnd.standard_normal((40, 6)).astype(np.float32)
    sizes = rnd.integers(0, 9, 200)
    sizes[[3, 77, 150]] = 500, topics.SHORT, topics.SHORT + 1
    at, rows = np.repeat(np.arange(200), sizes), rnd.integers(0, 40, sizes.sum())
    got, want = np.zeros((200, 6), np.float32), np.zeros((200, 6))
    topics._summed(got, at, table, rows)
    np.add.at(want, at, table[rows])
    assert np.allclose(got, want, atol=1e-3)
    topics._summed(got, at[:0], table, rows[:0])
    doc, term = np.nonzero(rnd.random((30, 40)) < 0.2)
    v, size = rnd.random(len(doc)).astype(np.float32), rnd.random(30).astype(np.float32) + 1
    m = np.zeros((30, 40))
    m[doc, term] = v
    for cells in (0, 1 << 22):
        monkeypatch.setattr(topics, "CELLS", cells)
        out = np.ones((40, 6))
        topics._multiplied((doc, term, v, size), table, out)
        assert np.allclose(out, 1 + m.T @ (m @ table / size[:, None]), atol=1e-4)


def test_subjects_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert topics.subject_areas(spark.createDataFrame([(1, "some text. more text.")], "doc_id long, text string"), none, ["law"]).count() == 0
    assert topics.subject_areas(spark.createDataFrame([], "doc_id long, text string"), none, ["law"]).count() == 0


def test_catalog_is_json_like():
    assert all(n.startswith("p") for n in json.loads(json.dumps(list(catalog.QUERIES))))

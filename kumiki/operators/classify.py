"""CLS1-CLS6, CLS8-CLS12: where an item of a source belongs: its type, the number of its task, and with these its section.

Every rule set is a column expression, a CASE over an ordered list of (condition, place); a place is a type and its task, the
type's usual one unless another is given. Only rules that look at neighbours (carried titles, positions of groups) take and give
a DataFrame. Null texts fit no rule; what no rule fits gets the set's last place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kumiki import dims
from kumiki.operators.quality import carry_forward

_TASK = {t: m for t, _, m, *_ in dims.TYPES}
_SECTION = {t: s for t, s, *_ in dims.TYPES}
KANA = "^[ぁ-ゖァ-ヺー゛゜・\\s　]+$"
KANJI = "[一-鿿]"

#: Labels of one source for vocabulary (two of them stand for each other's type) and for the other papers.
VOCABULARY = {"kanji_reading": "kanji_reading", "orthography": "orthography", "usage": "context", "paraphrase": "paraphrase", "context_defined_expressions": "usage"}
PAPERS = {
    "sentential_grammar_1": "grammar_form", "sentential_grammar_2": "sentence_order", "text_grammar": "text_grammar", "comprehension_short": "reading_short",
    "comprehension_mid": "reading_mid", "comprehension_long": "reading_long", "information_retrieval": "info_retrieval",
}
LISTENING = {"task_based_comprehension": 1, "point_comprehension": 2, "outline_comprehension": 3, "utterance": 4, "quick_response": 5}
#: Vietnamese labels of kinds, with type and task.
LABELS_VI = {
    "cách đọc kanji": ("kanji_reading", 1), "cách viết từ": ("orthography", 2), "hình thành từ": ("vocab_meaning", 3), "điền từ theo văn cảnh": ("context", 3),
    "thay đổi cách nói": ("paraphrase", 4), "ứng dụng từ": ("usage", 5), "lựa chọn ngữ pháp": ("grammar_form", 1), "lắp ghép câu": ("sentence_order", 2),
    "ngữ pháp theo đoạn văn": ("text_grammar", 3), "đoạn văn ngắn": ("reading_short", 4), "đoạn văn vừa": ("reading_mid", 5), "đoạn văn dài": ("reading_long", 6),
    "đọc hiểu tổng hợp": ("reading_long", None), "đọc hiểu chủ đề": ("reading_long", None), "tìm thông tin": ("info_retrieval", 7),
    "nghe hiểu chủ đề": ("listening", 1), "nghe hiểu điểm chính": ("listening", 2), "nghe hiểu khái quát": ("listening", 3), "nghe hiểu diễn đạt": ("listening", 4),
    "trả lời nhanh": ("listening", 5), "nghe hiểu tổng hợp": ("listening", None),
}
#: English beginnings of labels, with type and task.
LABELS_EN = {
    "kanji reading": ("kanji_reading", 1), "orthography": ("orthography", 2), "word formation": ("context", 3), "contextually-defined expressions": ("context", 3),
    "paraphrases": ("paraphrase", 4), "usage": ("usage", 5), "sentential grammar 1": ("grammar_form", 1), "sentential grammar 2": ("sentence_order", 2),
    "text grammar": ("text_grammar", 3), "comprehension (short passages)": ("reading_short", 4), "comprehension (mid-size passages)": ("reading_mid", 5),
    "comprehension (long passages)": ("reading_long", 6), "information retrieval": ("info_retrieval", 7), "task-based comprehension": ("listening", 1),
    "comprehension of key points": ("listening", 2), "comprehension of general outline": ("listening", 3), "verbal expressions": ("listening", 4), "quick response": ("listening", 5),
}
#: What the instruction of each task holds, one of the words at least.
VOCABULARY_KEYS = {1: ["読み方"], 2: ["字で書く"], 3: ["入れる", "入れの", "人れる"], 4: ["意味が"], 5: ["使い方"]}
GRAMMAR_KEYS = {
    1: ["入れる", "入れの", "人れる"], 2: ["★"], 3: ["文章全体", "中に入る"], 4: ["4)", "4」", "４)", "４）", "4）"], 5: ["2)", "２)", "２）", "2）"],
    6: ["文章を読ん"], 7: ["ページ", "案内", "お知らせ", "ポスター", "プリント", "問題7", "問題７"],
}
#: Sections by the code a page gives.
CODES = {"1": "moji", "2": "bunpo", "3": "dokkai", "4": "choukai"}
FALLBACK = {"moji": "vocab_meaning", "bunpo": "grammar_misc", "dokkai": "reading_mid", "choukai": "listening"}
USUAL = "usual"


def place(kind: str, task: int | None | str = USUAL) -> Column:
    """(section, mondai, type) of a type, in its usual task unless `task` is given."""
    task = _TASK[kind] if task == USUAL else task
    return F.struct(F.lit(_SECTION[kind]).alias("section"), F.lit(task).cast("int").alias("mondai"), F.lit(kind).alias("type"))


def decided(rules: list[tuple[Column, Column]], last: Column) -> Column:
    """The place of the first condition that holds."""
    out = F
    for condition, where in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), where)
    return out.otherwise(last)


def _has(c: Column, *words: str) -> Column:
    """Whether a text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _every(options: Column, condition) -> Column:
    return F.coalesce(F.forall(F.coalesce(options, F.array().cast("array<string>")), condition), F.lit(True))


def by_label(category: Column, label: Column, stem: Column) -> Column:
    """CLS1: a dictionary for each category; a vocabulary stem with a blank is a context item, one of usage without is a usage item."""
    vocabulary, papers, listening = category == "vocab", category == "grammar_reading", category == "listening"
    known = vocabulary & label.isin(*VOCABULARY)
    rules = [
        (known & _has(stem, "{{()}}"), place("context")),
        (known & label.isin("usage", "context_defined_expressions") & ~_has(stem, "{{", "（　）"), place("usage")),
        *((vocabulary & (label == k), place(t)) for k, t in VOCABULARY.items()),
        (vocabulary, place("vocab_meaning")),
        *((papers & (label == k), place(t)) for k, t in PAPERS.items()),
        (papers, place("grammar_misc")),
        *((listening & (label == k), place("listening", n)) for k, n in LISTENING.items()),
        (listening, place("listening")),
    ]
    return decided(rules, F.lit(None).cast("struct<section:string,mondai:int,type:string>"))


def by_shape(kind: Column, stem: Column, options: Column, latin: bool) -> Column:
    """CLS2: by the kind of quiz and the shapes of stem and options. `latin` is the set of the source whose options may be English."""
    kana = _every(options, lambda o: o.rlike(KANA))
    blank = stem.rlike(r"（[\s　]*＿*[\s　]*）|＿{2,}" + ("" if latin else r"|\([\s　]*\)"))
    target = F.contains(stem, F.lit("＿")) & ~blank
    english = _every(options, lambda o: o.rlike("[A-Za-z]") & ~o.rlike("[ぁ-ヺ一-龯]"))
    kanji, grammar = kind == "kanji", kind == "grammar"
    rules = [
        (kanji & target & kana, place("kanji_reading")),
        (kanji & target & (~english if latin else F.lit(True)), place("orthography")),
        (kanji, place("kanji_meaning")),
        (grammar & F.contains(stem, F.lit("★")), place("sentence_order")),
        (grammar, place("grammar_form")),
        *([(F.contains(stem, F.lit("読み方")) & kana, place("kanji_reading")), (english, place("vocab_meaning"))] if latin else []),
        (target, place("paraphrase")),
        (blank, place("context")),
    ]
    return decided(rules, place("vocab_meaning"))


def by_instruction(kind: Column, instruction: Column, stem: Column, passage: Column) -> Column:
    """CLS3: by the kind of post, key words of the instruction, and the length of the passage (350 and 900 characters)."""
    i = F.coalesce(instruction, F.lit(""))
    blank = stem.rlike(r"_{3,}|（[\s　]*）|\([\s　]*\)")
    quoted = F.regexp_extract(stem, "「([^」]+)」", 1)
    target = F.when(quoted != "", quoted).otherwise(F.element_at(F.split(stem, "\n"), -1))
    n = F.length(F.coalesce(passage, F.lit("")))
    grammar, kanji, words, reading = (kind == k for k in ("grammar", "kanji", "vocabulary", "reading"))
    rules = [
        (grammar & F.contains(stem, F.lit("★")), place("sentence_order")), (grammar, place("grammar_form")),
        (kanji & target.rlike(KANJI), place("kanji_reading")), (kanji, place("orthography")),
        (words & _has(i, "意味") & _has(i, "近い"), place("paraphrase")), (words & _has(i, "使い方", "用法"), place("usage")),
        (words & _has(i, "読み方"), place("kanji_reading")), (words & _has(i, "漢字") & _has(i, "書", "表記"), place("orthography")),
        (words & _has(i, "入れる", "入る"), place("context")), (words & _has(stem, "「") & ~blank, place("paraphrase")),
        (words & blank, place("context")), (words, place("vocab_meaning")),
        (reading & (n <= 350), place("reading_short")), (reading & (n <= 900), place("reading_mid")), (reading, place("reading_long")),
        (kind == "listening", place("listening")),
    ]
    return decided(rules, place("grammar_misc"))


def _numbered(task: Column, sections: tuple[str, ...]) -> Column:
    """The place of a task's number among the types of some sections; null where there is none."""
    rules = [(task == m, place(t)) for t, m in _TASK.items() if m and _SECTION[t] in sections]
    return decided(rules, F.lit(None).cast("struct<section:string,mondai:int,type:string>"))


def by_title(items: DataFrame, exam: str, block: str, order: str, title: str) -> DataFrame:
    """CLS4: `items` with `place`: the number in a title, else a guess by its key words, else the number carried from before.

    Block 1 holds vocabulary, block 2 grammar and reading. Items that no number reaches have a null place.
    """
    t = F.coalesce(F.col(title), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_extract(t, r"問題[\s　]*[:：]?[\s　]*(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"もんだい[\s　]*(\d+)", 1), F.lit(""))).cast("int")
    words = F.when(_has(t, "読み方"), 1).when(_has(t, "漢字"), 2).when(_has(t, "意味"), 4).when(_has(t, "使い方"), 5).when(_has(t, "入れるのに"), 3)
    grammar = F.when(_has(t, "★"), 2).when(_has(t, "文章"), 3).when(_has(t, "入れる"), 1)
    said = items.withColumn("_n", F.coalesce(number, F.when(F.col(block) == 1, words).otherwise(grammar)))
    carried = carry_forward(said, [exam, block], order, "_n")
    where = F.when(F.col(block) == 1, _numbered(F.col("_n"), ("moji",))).otherwise(_numbered(F.col("_n"), ("bunpo", "dokkai")))
    return carried.withColumn("place", where).drop("_n")


def by_position(items: DataFrame, exam: str, paper: str, group: str, order: str, instruction: str, passage: str) -> DataFrame:
    """CLS5: `items` with `place` and `odd`: the task is the place of the item's group in its paper; `odd` says that the group's
    instruction holds none of the task's words.

    Paper 'vocabulary' has 5 groups, 'grammar' 7; items of further groups have a null place. Where a grammar paper has six groups
    and the last one six items on two passages, tasks 6 and 7 were merged: the last two items are of task 7. Groups are few for
    each paper: only their table is ordered, items are numbered only in such merged groups.
    """
    g = items.groupBy(exam, paper, group).agg(
        F.min(order).alias("_first"), F.count("*").alias("_n"), F.min_by(instruction, order).alias("_i"), F.countDistinct(passage).alias("_p")
    )
    w = Window.partitionBy(exam, paper)
    g = g.withColumn("_task", F.row_number().over(w.orderBy("_first"))).withColumn("_groups", F.count("*").over(w))
    g = g.withColumn("_merged", (F.col(paper) == "grammar") & (F.col("_task") == 6) & (F.col("_groups") == 6) & (F.col("_n") == 6) & (F.col("_p") == 2))
    plain = F.regexp_replace(F.coalesce("_i", F.lit("")), r"[\s　]+", "")
    named = F
    for name, keys in (("vocabulary", VOCABULARY_KEYS), ("grammar", GRAMMAR_KEYS)):
        for task, words in keys.items():
            named = named.when((F.col(paper) == name) & (F.col("_task") == task), _has(plain, *words))
    g = g.withColumn("odd", ~named.otherwise(True))
    x, y = items.alias("x"), g.select(F.col(exam).alias("_e"), F.col(paper).alias("_pa"), F.col(group).alias("_g"), "_task", "_merged", "odd").alias("y")
    j = x.join(y, F.expr(f"x.`{exam}` <=> _e AND x.`{paper}` <=> _pa AND x.`{group}` <=> _g"))
    late = j.where("_merged").withColumn("_k", F.row_number().over(Window.partitionBy("_e", "_pa").orderBy(order)))
    late = late.withColumn("_task", F.when(F.col("_k") > 4, 7).otherwise(6)).drop("_k")
    out = j.where("NOT _merged").unionByName(late)
    where = F.when(F.col(paper) == "vocabulary", _numbered(F.col("_task"), ("moji",))).otherwise(_numbered(F.col("_task"), ("bunpo", "dokkai")))
    return out.withColumn("place", where).drop("_e", "_pa", "_g", "_task", "_merged")


def by_map(label: Column) -> Column:
    """CLS6: the place of a Vietnamese label; null for unknown ones."""
    return decided([(label == k, place(*v)) for k, v in LABELS_VI.items()], F.lit(None).cast("struct<section:string,mondai:int,type:string>"))


def by_prefix(label: Column) -> Column:
    """CLS6: the place of an English label by its beginning, case, spaces and a leading number of the task aside."""
    n = F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"[\s　]+", " ")), r"^問題 *[^ ]+ *- *", "")
    return decided([(F.startswith(n, F.lit(k)), place(*v)) for k, v in LABELS_EN.items()], place("grammar_misc"))


def by_group(group: Column, stem: Column, options: Column) -> Column:
    """CLS8: a short word as stem with three options that mark a target is a usage item; else by words of the quiz group."""
    g = F.lower(group)
    target = F.contains(stem, F.lit("＿"))
    marked = F.size(F.filter(options, lambda o: F.contains(o, F.lit("＿")))) >= 3
    rules = [
        ((F.length(stem) <= 8) & ~stem.rlike(r"[。、（）()]") & marked, place("usage")),
        (_has(g, "kanji") & target & _every(options, lambda o: o.rlike(KANA)), place("kanji_reading")),
        (_has(g, "kanji") & target, place("orthography")),
        (_has(g, "kanji"), place("kanji_meaning")),
        (_has(g, "grammar"), place("grammar_form")),
        (_has(g, "vocab") & _has(stem, "（", "(", "＿＿"), place("context")),
        (_has(g, "vocab"), place("vocab_meaning")),
        (_has(g, "listening"), place("listening")),
        (_has(g, "reading"), place("reading_short")),
    ]
    return decided(rules, place("vocab_meaning"))


def by_direction(kind: Column, direction: Column, instruction: Column) -> Column:
    """CLS9: by the kind of item; those of kanji by the direction asked for or the words of the instruction."""
    d, i = F.coalesce(direction, F.lit("")), F.coalesce(instruction, F.lit(""))
    kanji = kind.isin("kanji_choice", "kanji_reading")
    rules = [
        (kanji & ((d == "kanji_to_reading") | _has(i, "読み方")), place("kanji_reading")),
        (kanji & ((d == "reading_to_kanji") | _has(i, "漢字")), place("orthography")),
        (kind == "vocabulary", place("context")), (kind == "grammar", place("grammar_form")),
        (kind == "kanji_reading", place("kanji_reading")), (kind == "kanji_choice", place("orthography")),
    ]
    return decided(rules, F.lit(None).cast("struct<section:string,mondai:int,type:string>"))


def by_header(header: Column, kind: Column) -> Column:
    """CLS10: by key words of a page's header, then by the letter of its kind."""
    h = F.replace(F.coalesce(header, F.lit("")), F.lit(" "), F.lit(""))
    rules = [
        (_has(h, "読み方", "よみかた"), place("kanji_reading")), (_has(h, "同じひらがなで書く漢字"), place("orthography", None)),
        (_has(h, "正しい漢字", "ただしいかんじ"), place("orthography")), (_has(h, "使い方"), place("usage")), (_has(h, "同じ文", "同じ意味"), place("paraphrase")),
        (kind == "k", place("kanji_meaning")), (kind == "v", place("context")),
    ]
    return decided(rules, place("grammar_form"))


def by_content(code: Column, hint: Column, part: Column, task: Column, stem: Column) -> Column:
    """CLS11: the section by its code, else by the page's part; a grammar task corrected by what its stem shows."""
    section = F
    for k, s in CODES.items():
        section = section.when(code == k, s)
    section = section.when((part == 3) & (F.coalesce(task, F.lit(0)) <= 3), "bunpo").when(part == 3, "dokkai").otherwise(hint)
    star, number = F.contains(stem, F.lit("★")), stem.rlike(r"^【[\s　]*[0-9０-９]+[\s　]*】$")
    seen = F.when(star, 2).when(number, 3).when(task.isin(2, 3) & _has(stem, "（", "("), 1).otherwise(task)
    fixed = F.when(section == "bunpo", seen).otherwise(task)
    kind = F.when(section == "choukai", "listening")
    for t, m in _TASK.items():
        if m:
            kind = kind.when((section == _SECTION[t]) & (fixed == m), t)
    for s, t in FALLBACK.items():
        kind = kind.when(section == s, t)
    return F.struct(section.alias("section"), fixed.cast("int").alias("mondai"), kind.alias("type"))


def recovered_options(options: Column, transcript: Column) -> Column:
    """CLS11: options that aren't printed, from the numbered lines of the transcript, else their numbers; printed ones stay.

    Lines must be numbered 1, 2, ... and be as many as the options less one at least.
    """
    lines = F.filter(F.split(F.coalesce(transcript, F.lit("")), "\n"), lambda x: x.rlike(r"^[\s　]*[1-4１-４][\s　.．)）、]+.*[^\s　]"))
    number = F.transform(lines, lambda x: F.translate(F.regexp_extract(x, r"^[\s　]*([1-4１-４])", 1), "１２３４", "1234").cast("int"))
    texts = F.transform(lines, lambda x: F.regexp_extract(x, r"^[\s　]*[1-4１-４][\s　.．)）、]+(.+?)[\s　]*$", 1))
    n = F.size(lines)
    whole = (n > 0) & (number == F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))) & (n >= F.size(options) - 1)
    bare = (F.size(options) > 0) & F.forall(options, lambda o: o == "")
    return F.when(bare & whole, texts).when(bare, F.transform(options, lambda o, i: (i + 1).cast("string"))).otherwise(options)


def by_block(kind: Column, stem: Column) -> Column:
    """CLS12: quiz blocks of kanji, sentences to be put in order by their star, else forms of grammar."""
    return decided([(kind == "kanji", place("orthography")), (F.contains(stem, F.lit("★")), place("sentence_order"))], place("grammar_form"))

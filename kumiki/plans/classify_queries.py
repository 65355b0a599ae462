"""Queries of classification by source. Labels, headers and kinds of a crawl are taken from what the raw rows say of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki import dims
from kumiki.operators import classify as C
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
#: Of each type its section and usual task, for the SQL.
TY = "ty(type, section, mondai) AS (VALUES " + ", ".join(f"('{t}', '{s}', {m or 'NULL'})" for t, s, m, *_ in dims.TYPES) + ")"


def usual(source: str, kind: str, more: str = "") -> str:
    """SQL: rows of `source` with a type by `kind`, in its usual section and task."""
    return f"WITH {TY}, {more}k AS (SELECT rid, {kind} AS type FROM {source}) SELECT rid, ty.section, ty.mondai, k.type FROM k LEFT JOIN ty USING (type)"


def raw(spark, d):
    return table(spark, d, "raw")


def spread(df, place):
    return df.select("rid", place.alias("_at")).select("rid", "_at.section", "_at.mondai", "_at.type")


LABEL_OF = {
    "kanji_reading": "kanji_reading", "orthography": "orthography", "context": "usage", "paraphrase": "paraphrase", "usage": "context_defined_expressions",
    "grammar_form": "sentential_grammar_1", "sentence_order": "sentential_grammar_2", "text_grammar": "text_grammar", "reading_short": "comprehension_short",
    "reading_mid": "comprehension_mid", "reading_long": "comprehension_long", "info_retrieval": "information_retrieval",
}
CATEGORY = "CASE section WHEN 'moji' THEN 'vocab' WHEN 'choukai' THEN 'listening' ELSE 'grammar_reading' END"
CASE_LABEL = "CASE " + " ".join(f"WHEN type = '{t}' THEN '{v}'" for t, v in LABEL_OF.items()) + " WHEN type = 'listening' AND mondai = 1 THEN 'task_based_comprehension' WHEN type = 'listening' AND mondai = 2 THEN 'point_comprehension' END"


@R.add(
    "cls1_labels",
    f"""WITH {TY}, l AS (SELECT rid, question, {CATEGORY} AS c, {CASE_LABEL} AS l FROM raw),
    k AS (SELECT rid, c, l, CASE WHEN c = 'listening' THEN 'listening'
      WHEN c = 'vocab' AND l IN ('usage', 'context_defined_expressions') AND NOT contains(question, '{{{{') AND NOT contains(question, '（　）') THEN 'usage'
      WHEN c = 'vocab' THEN CASE l WHEN 'kanji_reading' THEN 'kanji_reading' WHEN 'orthography' THEN 'orthography' WHEN 'usage' THEN 'context' WHEN 'paraphrase' THEN 'paraphrase' WHEN 'context_defined_expressions' THEN 'usage' ELSE 'vocab_meaning' END
      ELSE CASE l WHEN 'sentential_grammar_1' THEN 'grammar_form' WHEN 'sentential_grammar_2' THEN 'sentence_order' WHEN 'text_grammar' THEN 'text_grammar' WHEN 'comprehension_short' THEN 'reading_short' WHEN 'comprehension_mid' THEN 'reading_mid' WHEN 'comprehension_long' THEN 'reading_long' WHEN 'information_retrieval' THEN 'info_retrieval' ELSE 'grammar_misc' END END AS type FROM l)
    SELECT rid, ty.section, CASE WHEN c = 'listening' THEN CASE l WHEN 'task_based_comprehension' THEN 1 WHEN 'point_comprehension' THEN 2 END ELSE ty.mondai END AS mondai, k.type FROM k JOIN ty USING (type)""",
)
def cls1(spark, d):
    return spread(raw(spark, d), C.by_label(F.expr(CATEGORY), F.expr(CASE_LABEL), F.col("question")))


KIND = "CASE WHEN type IN ('kanji_reading', 'orthography', 'kanji_meaning') THEN 'kanji' WHEN section = 'bunpo' THEN 'grammar' ELSE 'vocabulary' END"
_KANA_ONLY = "len(list_filter(coalesce(options, []), lambda o: NOT regexp_matches(o, '^[ぁ-ゖァ-ヺー゛゜・\\s\\x{3000}]+$'))) = 0"
_ENGLISH = "len(list_filter(coalesce(options, []), lambda o: NOT (regexp_matches(o, '[A-Za-z]') AND NOT regexp_matches(o, '[ぁ-ヺ一-龯]')))) = 0"
_SHAPES = f"SELECT rid, question AS q, {KIND} AS kind, {_KANA_ONLY} AS kana, {_ENGLISH} AS english, regexp_matches(question, '（[\\s\\x{{3000}}]*＿*[\\s\\x{{3000}}]*）|＿＿') AS blank, regexp_matches(question, '\\([\\s\\x{{3000}}]*\\)') AS ascii_blank FROM raw"


@R.add(
    "cls2_shapes",
    usual(
        f"({_SHAPES})",
        "CASE WHEN kind = 'kanji' AND contains(q, '＿') AND NOT (blank OR ascii_blank) THEN CASE WHEN kana THEN 'kanji_reading' ELSE 'orthography' END WHEN kind = 'kanji' THEN 'kanji_meaning' "
        "WHEN kind = 'grammar' THEN CASE WHEN contains(q, '★') THEN 'sentence_order' ELSE 'grammar_form' END WHEN blank OR ascii_blank THEN 'context' WHEN contains(q, '＿') THEN 'paraphrase' ELSE 'vocab_meaning' END",
    ),
)
def cls2(spark, d):
    return spread(raw(spark, d), C.by_shape(F.expr(KIND), F.col("question"), F.col("options"), False))


@R.add(
    "cls2_latin_shapes",
    usual(
        f"({_SHAPES})",
        "CASE WHEN kind = 'kanji' THEN CASE WHEN blank OR NOT contains(q, '＿') THEN 'kanji_meaning' WHEN kana THEN 'kanji_reading' WHEN english THEN 'kanji_meaning' ELSE 'orthography' END "
        "WHEN kind = 'grammar' THEN CASE WHEN contains(q, '★') THEN 'sentence_order' ELSE 'grammar_form' END WHEN contains(q, '読み方') AND kana THEN 'kanji_reading' WHEN english THEN 'vocab_meaning' WHEN blank THEN 'context' WHEN contains(q, '＿') THEN 'paraphrase' ELSE 'vocab_meaning' END",
    ),
)
def cls2_latin(spark, d):
    return spread(raw(spark, d), C.by_shape(F.expr(KIND), F.col("question"), F.col("options"), True))


POST = "CASE WHEN type = 'grammar_misc' THEN 'other' WHEN section = 'bunpo' THEN 'grammar' WHEN type LIKE 'kanji%' THEN 'kanji' WHEN section = 'moji' THEN 'vocabulary' WHEN section = 'dokkai' THEN 'reading' ELSE 'listening' END"


@R.add(
    "cls3_instructions",
    usual(
        f"(SELECT rid, {POST} AS kind, question AS q, coalesce(string_split(question, chr(10))[-1], '') AS i, length(coalesce(passage, '')) AS n, coalesce(nullif(regexp_extract(question, '「([^」]+)」', 1), ''), string_split(question, chr(10))[-1]) AS target, regexp_matches(question, '___|（[\\s\\x{{3000}}]*）|\\([\\s\\x{{3000}}]*\\)') AS blank FROM raw)".replace("{{3000}}", "{3000}"),
        "CASE kind WHEN 'grammar' THEN if(contains(q, '★'), 'sentence_order', 'grammar_form') WHEN 'kanji' THEN if(regexp_matches(target, '[一-鿿]'), 'kanji_reading', 'orthography') WHEN 'reading' THEN CASE WHEN n <= 350 THEN 'reading_short' WHEN n <= 900 THEN 'reading_mid' ELSE 'reading_long' END "
        "WHEN 'listening' THEN 'listening' WHEN 'other' THEN 'grammar_misc' ELSE CASE WHEN contains(i, '意味') AND contains(i, '近い') THEN 'paraphrase' WHEN contains(i, '使い方') OR contains(i, '用法') THEN 'usage' WHEN contains(i, '読み方') THEN 'kanji_reading' WHEN contains(i, '漢字') AND (contains(i, '書') OR contains(i, '表記')) THEN 'orthography' "
        "WHEN contains(i, '入れる') OR contains(i, '入る') THEN 'context' WHEN blank THEN 'context' WHEN contains(q, '「') THEN 'paraphrase' ELSE 'vocab_meaning' END END",
    ),
)
def cls3(spark, d):
    return spread(raw(spark, d), C.by_instruction(F.expr(POST), F.element_at(F.split("question", "\n"), -1), F.col("question"), F.col("passage")))


TITLE = "CASE WHEN mondai IS NOT NULL AND section <> 'bunpo' THEN concat('問題', mondai) ELSE question END"
BLOCK = "CASE WHEN section = 'moji' THEN 1 ELSE 2 END"


@R.add(
    "cls4_titles",
    f"""WITH {TY}, t AS (SELECT rid, exam, {BLOCK} AS b, coalesce({TITLE}, '') AS t FROM raw WHERE exam IS NOT NULL AND section <> 'choukai'),
    n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(t, '問題[\\s\\x{{3000}}]*[:：]?[\\s\\x{{3000}}]*([0-9]+)', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, 'もんだい[\\s\\x{{3000}}]*([0-9]+)', 1), '') AS INT),
      CASE WHEN b = 1 THEN CASE WHEN contains(t, '読み方') THEN 1 WHEN contains(t, '漢字') THEN 2 WHEN contains(t, '意味') THEN 4 WHEN contains(t, '使い方') THEN 5 WHEN contains(t, '入れるのに') THEN 3 END ELSE CASE WHEN contains(t, '★') THEN 2 WHEN contains(t, '文章') THEN 3 WHEN contains(t, '入れる') THEN 1 END END) AS n FROM t),
    c AS (SELECT rid, b, last_value(n IGNORE NULLS) OVER (PARTITION BY exam, b ORDER BY rid) AS n FROM n)
    SELECT rid, ty.section, ty.mondai, ty.type FROM c LEFT JOIN ty ON ty.mondai = c.n AND (ty.section = 'moji') = (b = 1)""",
)
def cls4(spark, d):
    x = raw(spark, d).where("exam IS NOT NULL AND section <> 'choukai'").select("rid", "exam", F.expr(BLOCK).alias("block"), F.expr(TITLE).alias("title"))
    return spread(C.by_title(x, "exam", "block", "rid", "title"), F.col("place"))


@R.add(
    "cls5_positions",
    f"""WITH {TY}, q AS (SELECT rid, exam, if(section = 'moji', 'vocabulary', 'grammar') AS paper, type AS g, question, passage FROM raw WHERE exam IS NOT NULL AND section <> 'choukai'),
    g AS (SELECT exam, paper, g, min(rid) AS f, count(*) AS n, arg_min(question, rid) AS i, count(DISTINCT passage) AS p FROM q GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY exam, paper ORDER BY f) AS task, count(*) OVER (PARTITION BY exam, paper) AS gs, regexp_replace(coalesce(i, ''), '[\\s\\x{{3000}}]+', '', 'g') AS ins FROM g),
    j AS (SELECT q.rid, q.paper, o.ins, o.task AS t0, CASE WHEN q.paper = 'grammar' AND task = 6 AND gs = 6 AND o.n = 6 AND o.p = 2 AND row_number() OVER (PARTITION BY q.exam, q.paper, q.g ORDER BY rid) > 4 THEN 7 ELSE task END AS task FROM q JOIN o USING (exam, paper, g)),
    kw(paper, t0, w) AS (VALUES {', '.join(f"('{p}', {t}, '{w}')" for p, keys in (('vocabulary', C.VOCABULARY_KEYS), ('grammar', C.GRAMMAR_KEYS)) for t, ws in keys.items() for w in ws)})
    SELECT rid, ty.section, ty.mondai, ty.type, t0 <= if(paper = 'vocabulary', 5, 7) AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.paper = j.paper AND kw.t0 = j.t0 AND contains(ins, w)) AS odd
    FROM j LEFT JOIN ty ON ty.mondai = j.task AND (ty.section = 'moji') = (j.paper = 'vocabulary')""",
)
def cls5(spark, d):
    x = raw(spark, d).where("exam IS NOT NULL AND section <> 'choukai'")
    x = x.select("rid", "exam", F.expr("if(section = 'moji', 'vocabulary', 'grammar')").alias("paper"), F.col("type").alias("g"), "question", "passage")
    return C.by_position(x, "exam", "paper", "g", "rid", "question", "passage").select("rid", "place.section", "place.mondai", "place.type", "odd")


VI_OF = {
    "kanji_reading": "cách đọc kanji", "orthography": "cách viết từ", "context": "điền từ theo văn cảnh", "paraphrase": "thay đổi cách nói", "usage": "ứng dụng từ", "grammar_form": "lựa chọn ngữ pháp",
    "sentence_order": "lắp ghép câu", "text_grammar": "ngữ pháp theo đoạn văn", "reading_short": "đoạn văn ngắn", "reading_mid": "đoạn văn vừa", "reading_long": "đoạn văn dài", "info_retrieval": "tìm thông tin", "listening": "nghe hiểu khái quát", "vocab_meaning": "hình thành từ",
}
VI_LABEL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in VI_OF.items()) + " ELSE type END"


@R.add(
    "cls6_labels",
    f"WITH {TY} SELECT rid, CASE WHEN type IN ('kanji_meaning', 'grammar_misc') THEN NULL ELSE ty.section END AS section, CASE type WHEN 'listening' THEN 3 WHEN 'vocab_meaning' THEN 3 WHEN 'kanji_meaning' THEN NULL WHEN 'grammar_misc' THEN NULL ELSE ty.mondai END AS mondai, "
    "CASE WHEN type IN ('kanji_meaning', 'grammar_misc') THEN NULL ELSE type END AS type FROM raw LEFT JOIN (SELECT type AS t, section, mondai FROM ty) ty ON t = type".replace("ELSE ty.section", "ELSE ty.section"),
)
def cls6(spark, d):
    return spread(raw(spark, d), C.by_map(F.expr(VI_LABEL)))


EN_OF = {
    "kanji_reading": "Kanji  Reading", "orthography": "Orthography", "context": "Contextually-defined Expressions", "paraphrase": "Paraphrases", "usage": "Usage", "grammar_form": "Sentential Grammar 1 (form)",
    "sentence_order": "Sentential Grammar 2", "text_grammar": "Text grammar", "reading_short": "Comprehension (Short passages)", "reading_mid": "Comprehension (Mid-size passages)", "reading_long": "Comprehension (Long passages)", "info_retrieval": "Information retrieval", "listening": "Quick response", "vocab_meaning": "Word Formation",
}
EN_LABEL = "concat('問題', coalesce(mondai, 9), ' - ', CASE type " + " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in EN_OF.items()) + " ELSE type END)"


@R.add(
    "cls6_prefixes",
    f"WITH {TY}, k AS (SELECT rid, CASE type WHEN 'vocab_meaning' THEN 'context' WHEN 'kanji_meaning' THEN 'grammar_misc' ELSE type END AS type FROM raw) SELECT rid, ty.section, CASE WHEN k.type = 'listening' THEN 5 ELSE ty.mondai END AS mondai, k.type FROM k JOIN ty USING (type)",
)
def cls6_prefix(spark, d):
    return spread(raw(spark, d), C.by_prefix(F.expr(EN_LABEL)))


GROUP = "CASE WHEN type LIKE 'kanji%' OR type = 'orthography' THEN 'N3 Kanji Quiz' WHEN section = 'bunpo' THEN 'Grammar N3' WHEN section = 'dokkai' THEN 'Reading N3' WHEN section = 'choukai' THEN 'Listening N3' WHEN type = 'usage' THEN 'other' ELSE 'Vocabulary N3' END"


@R.add(
    "cls8_groups",
    usual(
        f"(SELECT rid, question AS q, {GROUP} AS g, {_KANA_ONLY} AS kana, len(list_filter(options, lambda o: contains(o, '＿'))) AS marked FROM raw)",
        "CASE WHEN length(q) <= 8 AND NOT regexp_matches(q, '[。、（）()]') AND marked >= 3 THEN 'usage' WHEN g LIKE '%Kanji%' THEN CASE WHEN NOT contains(q, '＿') THEN 'kanji_meaning' WHEN kana THEN 'kanji_reading' ELSE 'orthography' END WHEN g LIKE 'Grammar%' THEN 'grammar_form' "
        "WHEN g LIKE 'Vocab%' THEN CASE WHEN contains(q, '（') OR contains(q, '(') OR contains(q, '＿＿') THEN 'context' ELSE 'vocab_meaning' END WHEN g LIKE 'Listening%' THEN 'listening' WHEN g LIKE 'Reading%' THEN 'reading_short' ELSE 'vocab_meaning' END",
    ),
)
def cls8(spark, d):
    return spread(raw(spark, d), C.by_group(F.expr(GROUP), F.col("question"), F.col("options")))


CHOICE = "CASE WHEN type = 'orthography' THEN 'kanji_choice' WHEN type LIKE 'kanji%' THEN 'kanji_reading' WHEN section = 'bunpo' THEN 'grammar' WHEN section = 'moji' THEN 'vocabulary' END"
DIRECTION = "CASE WHEN type = 'kanji_meaning' THEN 'reading_to_kanji' END"


@R.add(
    "cls9_directions",
    usual(
        "raw",
        "CASE WHEN section NOT IN ('moji', 'bunpo') AND type NOT LIKE 'kanji%' AND type <> 'orthography' THEN NULL WHEN type = 'orthography' OR type LIKE 'kanji%' THEN CASE WHEN contains(question, '読み方') THEN 'kanji_reading' WHEN type = 'kanji_meaning' OR contains(question, '漢字') THEN 'orthography' WHEN type = 'orthography' THEN 'orthography' ELSE 'kanji_reading' END WHEN section = 'bunpo' THEN 'grammar_form' ELSE 'context' END",
    ),
)
def cls9(spark, d):
    return spread(raw(spark, d), C.by_direction(F.expr(CHOICE), F.expr(DIRECTION), F.col("question")))


LETTER = "CASE WHEN type LIKE 'kanji%' THEN 'k' WHEN section = 'moji' THEN 'v' ELSE 'g' END"


@R.add(
    "cls10_headers",
    f"WITH {TY}, k AS (SELECT rid, {LETTER} AS l, replace(coalesce(question, ''), ' ', '') AS h FROM raw), t AS (SELECT rid, contains(h, '同じひらがなで書く漢字') AND NOT contains(h, '読み方') AND NOT contains(h, 'よみかた') AS homophone, "
    "CASE WHEN contains(h, '読み方') OR contains(h, 'よみかた') THEN 'kanji_reading' WHEN contains(h, '同じひらがなで書く漢字') OR contains(h, '正しい漢字') OR contains(h, 'ただしいかんじ') THEN 'orthography' WHEN contains(h, '使い方') THEN 'usage' WHEN contains(h, '同じ文') OR contains(h, '同じ意味') THEN 'paraphrase' "
    "WHEN l = 'k' THEN 'kanji_meaning' WHEN l = 'v' THEN 'context' ELSE 'grammar_form' END AS type FROM k) SELECT rid, ty.section, CASE WHEN NOT homophone THEN ty.mondai END AS mondai, t.type FROM t JOIN ty USING (type)",
)
def cls10(spark, d):
    return spread(raw(spark, d), C.by_header(F.col("question"), F.expr(LETTER)))


CODE = "CASE WHEN furigana THEN CASE section WHEN 'moji' THEN '1' WHEN 'bunpo' THEN '2' WHEN 'dokkai' THEN '3' ELSE '4' END END"
PART = "CASE section WHEN 'moji' THEN 1 WHEN 'choukai' THEN 4 ELSE 3 END"
HINT = "CASE section WHEN 'moji' THEN 'moji' WHEN 'choukai' THEN 'choukai' ELSE 'bunpo' END"


@R.add(
    "cls11_contents",
    f"""WITH {TY}, s AS (SELECT rid, question AS q, mondai AS m, CASE WHEN furigana THEN section WHEN section IN ('moji', 'choukai') THEN section WHEN coalesce(mondai, 0) <= 3 THEN 'bunpo' ELSE 'dokkai' END AS section FROM raw),
    m AS (SELECT rid, section, CASE WHEN section <> 'bunpo' THEN m WHEN contains(q, '★') THEN 2 WHEN regexp_matches(q, '^【[\\s\\x{{3000}}]*[0-9０-９]+[\\s\\x{{3000}}]*】$') THEN 3 WHEN m IN (2, 3) AND (contains(q, '（') OR contains(q, '(')) THEN 1 ELSE m END AS mondai FROM s)
    SELECT rid, m.section, m.mondai, CASE WHEN m.section = 'choukai' THEN 'listening' ELSE coalesce(ty.type, CASE m.section WHEN 'moji' THEN 'vocab_meaning' WHEN 'bunpo' THEN 'grammar_misc' ELSE 'reading_mid' END) END AS type FROM m LEFT JOIN ty ON ty.section = m.section AND ty.mondai = m.mondai""",
)
def cls11(spark, d):
    return spread(raw(spark, d), C.by_content(F.expr(CODE), F.expr(HINT), F.expr(PART), F.col("mondai"), F.col("question")))


PAGE = "CASE WHEN section = 'choukai' THEN concat('男：', array_join(transform(options, (o, i) -> concat('\\n', i + 1, '. ', o, ' ')), '')) END"


@R.add(
    "cls11_recovered_options",
    "SELECT rid, CASE WHEN section <> 'choukai' THEN options WHEN len(list_filter(options, lambda o: regexp_matches(o, '[^\\s\\x{3000}]') AND NOT contains(o, chr(10)))) = len(options) THEN list_transform(options, lambda o: trim(regexp_replace(o, '^[\\s\\x{3000}.．)）、]+|[\\s\\x{3000}]+$', '', 'g'))) END AS options FROM raw "
    "WHERE section <> 'choukai' OR len(list_filter(options, lambda o: regexp_matches(o, '^[^\\s\\x{3000}.．)）、]') AND NOT contains(o, chr(10)))) = len(options)",
)
def cls11_options(spark, d):
    """Listening options are hidden and found again in a transcript that lists them."""
    x = raw(spark, d).where(r"section <> 'choukai' OR forall(options, o -> o rlike '^[^\\s　.．)）、]' AND NOT contains(o, '\n'))")
    hidden = F.when(F.col("section") == "choukai", F.transform("options", lambda o: F.lit(""))).otherwise(F.col("options"))
    return x.select("rid", C.recovered_options(hidden, F.expr(PAGE)).alias("options"))


@R.add("cls12_blocks", usual("raw", "CASE WHEN type LIKE 'kanji%' OR type = 'orthography' THEN 'orthography' WHEN contains(question, '★') THEN 'sentence_order' ELSE 'grammar_form' END"))
def cls12(spark, d):
    return spread(raw(spark, d), C.by_block(F.expr("CASE WHEN type LIKE 'kanji%' OR type = 'orthography' THEN 'kanji' END"), F.col("question")))

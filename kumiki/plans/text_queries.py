"""Queries of the scalar text functions over raw questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.functions import text as T
from kumiki.functions.markup import html_text
from kumiki.plans.nfkc import nfkc, norm
from kumiki.plans.registry import Registry
from kumiki.session import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def _raw(spark, d):
    return table(spark, d, "raw")


def _one(f, *cols):
    def run(spark, d):
        return _raw(spark, d).select("rid", f(*[F.col(c) for c in cols]).alias("v"))

    return run


def _translated(column: str, signs: str) -> str:
    quoted = signs.replace("'", "''")
    return f"translate({column}, '{quoted}', '')"


R.add("txt1_norm", f"SELECT rid, {norm('question')} AS v FROM raw")(_one(T.norm, "question"))
R.add("txt6_slug", f"SELECT rid, CASE WHEN v <> '' THEN v WHEN exam IS NOT NULL THEN substr(sha1(exam), 1, 8) END AS v FROM (SELECT rid, exam, lower(regexp_replace(regexp_replace(strip_accents({nfkc('exam')}), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS v FROM raw)")(_one(T.slug, "exam"))
R.add("txt2_fix_spacing", "SELECT rid, regexp_replace(regexp_replace(question, '([぀-ヿ㐀-鿿]) +([぀-ヿ㐀-鿿])', '\\1\\2', 'g'), '([぀-ヿ㐀-鿿]) +([぀-ヿ㐀-鿿])', '\\1\\2', 'g') AS v FROM raw")(_one(T.fix_spacing, "question"))
R.add(
    "txt3_clean_text",
    r"SELECT rid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g') AS v FROM raw",
)(_one(T.clean_text, "question"))
R.add("txt9_norm_ja", f"SELECT rid, {_translated('question', T.IGNORED_JA)} AS v FROM raw")(_one(T.norm_ja, "question"))


@R.add(
    "txt10_kanji_chars",
    "WITH k AS (SELECT rid, regexp_extract_all(question, '[一-龯㐀-䶿]') AS l FROM raw) "
    "SELECT rid, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '') AS v FROM k",
)
def txt10(spark, d):
    return _raw(spark, d).select("rid", F.array_join(T.kanji_chars(F.col("question")), "").alias("v"))


_RUN = "regexp_extract(question, '[＿★＊](?:[ 　]+[＿★＊])+')"


@R.add(
    "txt5_stems",
    f"""WITH a AS (SELECT rid, question, type, {_RUN} AS run FROM raw),
    b AS (SELECT *, regexp_extract_all(run, '[＿★＊]') AS t,
      CASE WHEN type = 'grammar_form' AND contains(question, '★') THEN 'sentence_order' ELSE type END AS kind,
      regexp_extract(question, '^([^\\n]+)\\n([^\\n]{{1,12}})$', 1) AS head, regexp_extract(question, '^([^\\n]+)\\n([^\\n]{{1,12}})$', 2) AS word FROM a),
    c AS (SELECT *, len(list_filter(t, lambda x: x <> '＿')) AS stars, list_position(list_transform(t, lambda x: x <> '＿'), true) - 1 AS spot FROM b),
    e AS (SELECT *, CASE WHEN len(t) = 4 THEN spot WHEN len(t) = 9 THEN spot // 2 END AS k FROM c)
    SELECT rid, kind, CASE WHEN kind = 'sentence_order' THEN
        CASE WHEN stars = 1 AND len(t) IN (4, 9) THEN replace(question, run, array_to_string(list_transform(range(4), lambda i: CASE WHEN i = k THEN '＿★＿' ELSE '＿＿＿' END), ' ')) ELSE question END
      WHEN type IN ('kanji_reading', 'orthography', 'paraphrase') AND NOT contains(question, '＿') AND word <> '' AND length(head) - length(replace(head, word, '')) = length(word)
        THEN replace(head, word, '＿' || word || '＿') ELSE question END AS v FROM e""",
)
def txt5(spark, d):
    q, k = F.col("question"), F.col("type")
    return _raw(spark, d).select("rid", T.stem_type(q, k).alias("kind"), T.normalize_stem(q, k).alias("v"))


@R.add("txt7_natural", "SELECT id, regexp_replace(regexp_replace(id, '([0-9]+)', '000000000000\\1', 'g'), '0*([0-9]{12})([^0-9]|$)', '\\1\\2', 'g') AS v FROM bank")
def txt7(spark, d):
    return table(spark, d, "bank").select("id", T.natural(F.col("id")).alias("v"))


_PAIRS = [("下線", "＿"), ("ですか", "でしょうか"), ("選んでください", "選びなさい")]


@R.add(
    "txt8_replace_all",
    "WITH a AS (SELECT rid, question, replace(question, '下線', '＿') AS s1 FROM raw), b AS (SELECT *, replace(s1, 'ですか', 'でしょうか') AS s2 FROM a) "
    "SELECT rid, replace(s2, '選んでください', '選びなさい') AS v, (NOT contains(question, '下線'))::INT + (NOT contains(s1, 'ですか'))::INT + (NOT contains(s2, '選んでください'))::INT AS missing FROM b",
)
def txt8(spark, d):
    q = F.col("question")
    return _raw(spark, d).select("rid", T.replace_all(q, _PAIRS).alias("v"), F.size(T.unmatched(q, _PAIRS)).alias("missing"))


R.add("txt11_plain", r"SELECT rid, regexp_replace(regexp_replace(question, '\{([^{}|]+)\|[^{}|]*\}', '\1', 'g'), '\[\[u:(.*?)\]\]', '\1', 'g') AS v FROM raw")(_one(T.plain, "question"))
R.add("txt13_trunc", r"SELECT rid, CASE WHEN length(c) > 40 THEN substr(c, 1, 40) || '…' ELSE c END AS v FROM (SELECT rid, regexp_replace(regexp_replace(question, '\s+', ' ', 'g'), '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g') AS c FROM raw)")(_one(lambda c: T.trunc(c, 40), "question"))
R.add("txt13_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS v FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", T.escape_html(F.col("text")).alias("v"))
)
QUERIES["txt12_render"] = _one(T.render, "question")
QUERIES["txt14_html_text"] = lambda spark, d: table(spark, d, "documents").select("doc_id", html_text("text").alias("v"))
QUERIES["txt15_pseudo_markup"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.pseudo_markup(F.col("text")).alias("v"))
QUERIES["txt16_ocr_newlines"] = lambda spark, d: table(spark, d, "documents").select("doc_id", T.ocr_newlines(F.col("text")).alias("v"))
QUERIES["txt17_ocr_line"] = _one(T.ocr_line, "question")
QUERIES["txt18_options"] = lambda spark, d: _raw(spark, d).select("rid", T.strip_numbers(F.col("options")).alias("v"))
QUERIES["txt19_furigana"] = _one(T.strip_furigana, "question")
R.add("txt20_inline_marks", r"SELECT rid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(question, '\{\{\(\s*\)\}\}', '（　　）', 'g'), '\{\{([^{}]+)\}\}', '＿\1＿', 'g'), '\[\s*\]', '＿＿＿', 'g'), '\[([^\[\]]+)\]', '＿\1＿', 'g') AS v FROM raw")(_one(T.inline_marks, "question"))
R.add("txt21_hiragana", f"SELECT rid, translate(question, '{T.KATAKANA}', '{T.HIRAGANA}') AS v FROM raw")(_one(T.hiragana, "question"))
R.add("txt22_senses", r"WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x, '^\s*[0-9]+[.)]')), lambda x: regexp_replace(regexp_replace(x, '^\s*[0-9]+[.)]\s*', ''), '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')) AS n FROM a) SELECT doc_id, CASE WHEN len(n) > 0 THEN array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i)[1:3], '; ') ELSE regexp_replace(l[1], '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g') END AS v FROM b")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", T.senses(F.col("text")).alias("v"))
)
R.add("txt23_part_of_speech", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(?i:v1|ichidan|v5|godan|vs|suru|verb)') THEN 'verb' WHEN regexp_matches(p_type, '^(?i:adj-na|na-adj)') THEN 'na-adjective' WHEN regexp_matches(p_type, '^(?i:adj-i|i-adj|adjective)') THEN 'i-adjective' WHEN regexp_matches(p_type, '^(?i:adv)') THEN 'adverb' WHEN regexp_matches(p_type, '^(?i:prt|particle)') THEN 'particle' WHEN regexp_matches(p_type, '^(?i:conj)') THEN 'conjunction' WHEN regexp_matches(p_type, '^(?i:int|interjection)') THEN 'interjection' WHEN regexp_matches(p_type, '^(?i:n|noun)') THEN 'noun' WHEN p_name LIKE 'to %' THEN 'verb' WHEN p_name LIKE '%い' THEN 'i-adjective' ELSE 'noun' END AS v FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", T.part_of_speech(F.col("p_type"), F.col("p_name"), F.col("p_name")).alias("v"))
)


@R.add("txt24_headword", r"WITH a AS (SELECT rid, regexp_replace(regexp_split_to_array(options[1], '[;；]')[1], '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g') AS f FROM raw) SELECT rid, regexp_replace(f, '[〜～~!！]', '', 'g') AS word, CASE WHEN regexp_matches(f, '^[〜～~]') THEN 'suffix' WHEN regexp_matches(f, '[〜～~]$') THEN 'prefix' WHEN regexp_matches(f, '[!！]$') THEN 'interjection' END AS pos FROM a")
def txt24(spark, d):
    return _raw(spark, d).select("rid", T.headword(F.get("options", F.lit(0))).alias("h")).select("rid", "h.word", "h.pos")


@R.add("txt25_url", "SELECT rid, replace(replace(CASE WHEN audio LIKE '//%' THEN 'https:' || audio WHEN regexp_matches(audio, '^https?://') THEN audio ELSE 'https://x.example/' || ltrim(audio, '/') END, 'https://', 'https:||'), '//', '/').replace('https:||', 'https://') AS v FROM raw")
def txt25(spark, d):
    return _raw(spark, d).select("rid", T.absolute_url(F.col("audio"), "https://x.example").alias("v"))


@R.add(
    "txt26_completed",
    r"""WITH p AS (SELECT pid, min(text) AS passage FROM passages GROUP BY pid), n AS (SELECT id AS nid, max(note) AS note FROM explain_out GROUP BY id),
    a AS (SELECT id, built_at, type, question, options[answer + 1] AS r, passage, note FROM bank LEFT JOIN p ON pid = passage_id LEFT JOIN n ON nid = id)
    SELECT id, built_at, CASE WHEN type = 'sentence_order' AND note IS NOT NULL THEN nullif(regexp_extract(note, '[:：]\s*([^。]*。)', 1), '')
      WHEN type = 'text_grammar' AND regexp_matches(coalesce(passage, ''), '【\s*[0-9]+\s*】') THEN regexp_replace(regexp_extract(passage, '([^。！？\n]*【\s*[0-9]+\s*】[^。！？\n]*[。！？\n]?)', 1), '【\s*[0-9]+\s*】', '＿', 'g')
      WHEN regexp_matches(question, '[（(][\s\x{3000}]*[)）]') THEN regexp_extract(question, '(?s)^(.*?)[（(][\s\x{3000}]*[)）]', 1) || r || regexp_extract(question, '(?s)^.*?[（(][\s\x{3000}]*[)）](.*)$', 1) END AS v FROM a""",
)
def txt26(spark, d):
    p = table(spark, d, "passages").groupBy("pid").agg(F.min("text").alias("passage"))
    n = table(spark, d, "explain_out").groupBy(F.col("id").alias("nid")).agg(F.max("note").alias("note"))
    b = table(spark, d, "bank").join(p, F.expr("pid = passage_id"), "left").join(n, F.expr("nid = id"), "left")
    r = F.get("options", F.col("answer"))
    return b.select("id", "built_at", T.completed(F.col("type"), F.col("question"), r, F.col("passage"), F.col("note")).alias("v"))


QUERIES["txt27_transcript"] = lambda spark, d: _raw(spark, d).select("rid", T.longest_transcript(F.array("transcript", "passage", "question")).alias("v"))
R.add("txt28_digits", "SELECT rid, translate(question, '０１２３４５６７８９', '0123456789') AS v FROM raw")(_one(T.ascii_digits, "question"))


@R.add("txt29_explanation", r"WITH n AS (SELECT id AS nid, max(trans) AS trans, max(note) AS note FROM explain_out GROUP BY id) SELECT id, built_at, coalesce(nullif(regexp_replace(note, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g'), ''), nullif(regexp_replace(trans, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g'), ''), nullif(regexp_replace(explanation, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g'), ''), 'none') AS v FROM bank LEFT JOIN n ON nid = id")
def txt29(spark, d):
    n = table(spark, d, "explain_out").groupBy(F.col("id").alias("nid")).agg(F.max("trans").alias("trans"), F.max("note").alias("note"))
    b = table(spark, d, "bank").join(n, F.expr("nid = id"), "left")
    return b.select("id", "built_at", T.explanation_of(F.col("trans"), F.col("note"), F.col("explanation"), "none").alias("v"))

_STRIP = r"regexp_replace({}, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g')"
_RUBY = r"regexp_replace({}, '([一-龯々])[（(][ぁ-ゖァ-ヺー]+[)）]', '\1', 'g')"
_ESC = "replace(replace(replace(replace(replace(question, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_CELLS = r"regexp_replace(regexp_replace(text, '(?i)</t[dh]>\s*<t[dh][^>]*>', ' | ', 'g'), '(?i)<br\s*/?>|</tr>|</p>|</div>', chr(10), 'g')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_SPACED = r"regexp_replace(regexp_replace({}, '([぀-ヿ㐀-鿿]) +([぀-ヿ㐀-鿿])', '\1\2', 'g'), '([぀-ヿ㐀-鿿]) +([぀-ヿ㐀-鿿])', '\1\2', 'g')"
_LATIN = r"regexp_replace({}, '([A-Za-z0-9,.])\n([A-Za-z0-9])', '\1 \2', 'g')"
ORACLES["txt12_render"] = (
    "SELECT rid, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + _ESC
    + r", '\{([^{}|]+)\|([^{}|]*)\}', '<ruby>\1<rt>\2</rt></ruby>', 'g'), '\[\[img:(https?://[^\s\]]+)\]\]\n?', '<img src=@\1@>', 'g'), '\[\[u:(.*?)\]\]', '<u>\1</u>', 'g'), '＿([^＿★\s]+)＿', '<u>\1</u>', 'g'), "
    r"'＿{2,}[ \x{3000}]*([0-9０-９]{1,2})[ \x{3000}]*＿{2,}', '<span class=@blank@>\1</span>', 'g'), '＿{2,}', '<span class=@blank@></span>', 'g'), '★', '<b>★</b>'), '\n', '<br>', 'g') AS v FROM raw"
).replace("@", '"')  # no other at sign stands in it
_PAGE = "'A **b** [[img:https://a.b/' || rid || '.png]]' || chr(10) || '＿＿ 3 ＿＿' || chr(10) || question"
R.add("txt12_images", ORACLES["txt12_render"].replace("FROM raw", f"FROM (SELECT rid, {_PAGE} AS question FROM raw)"))(
    lambda spark, d: _raw(spark, d).select("rid", T.render(F.concat(F.lit("A **b** [[img:https://a.b/"), F.col("rid").cast("string"), F.lit(".png]]\n＿＿ 3 ＿＿\n"), "question")).alias("v"))
)
_HEX = "md5(CAST(rid AS VARCHAR))"
R.add("txt12_rich", f"SELECT rid, '<p>x &lt;' || {_HEX} || '<br>y</p><ul><li><b>' || {_HEX} || '</b></li><li>z</li></ul><p>w</p><p>v</p>' AS v FROM raw")(
    lambda spark, d: _raw(spark, d).select("rid", F.md5(F.col("rid").cast("string")).alias("h")).select("rid", T.rich(F.concat(F.lit("x <"), "h", F.lit("\ny\n - **"), "h", F.lit("**\n• z\nw\n\n\nv"))).alias("v"))
)
R.add("txt14_built_pages", f"SELECT rid, {_HEX} || chr(10) || 'a & b' || repeat(chr(10), 2) || '漢字' || repeat(chr(10), 2) || {_HEX} || ' | ＿c＿' AS v FROM raw")(
    lambda spark, d: _raw(spark, d).select("rid", F.md5(F.col("rid").cast("string")).alias("h")).select(
        "rid", html_text(F.concat(F.lit("<style>x</style><div> "), "h", F.lit("<br>a &amp; b</div><script>if (a < b) {}</script><p><ruby>漢<rp>(</rp><rt>かん</rt></ruby>字</p><table><tr><td>"), "h", F.lit("</td><td><u>c</u></td></tr></table>"))).alias("v")
    )
)
ORACLES["txt15_pseudo_markup"] = "SELECT doc_id, " + _STRIP.format(_CLEAN.format(_RUBY.format(_RUBY.format(f"regexp_replace({_CELLS}, '<[^>]+>', '', 'g')")))) + " AS v FROM documents"
ORACLES["txt16_ocr_newlines"] = (
    "SELECT doc_id, translate(regexp_replace("
    + _LATIN.format(_LATIN.format(r"regexp_replace(regexp_replace(text, '([。！？!?」])\n', '\1' || chr(1), 'g'), '\n([・●■①-⑳\-•])', chr(1) || '\1', 'g')"))
    + r", '\n', '', 'g'), chr(1), chr(10)) AS v FROM documents"
)
ORACLES["txt17_ocr_line"] = "SELECT rid, regexp_replace(" + _SPACED.format("question") + r", '(?m)^([0-9])[)）]\s*', '\1 ', 'g') AS v FROM raw"
ORACLES["txt18_options"] = (
    r"WITH a AS (SELECT rid, options, len(list_filter(options, lambda x: regexp_matches(x, '^\s*[1-4１-４][.．)）、:：\s]'))) AS numbered, "
    r"len(list_filter(options, lambda x, i: translate(regexp_extract(x, '^\s*([1-4１-４])', 1), '１２３４', '1234') = CAST(i AS VARCHAR))) AS own FROM raw) "
    "SELECT rid, CASE WHEN numbered >= 3 OR (own = len(options) AND len(options) > 0) THEN list_transform(options, lambda x: " + _STRIP.format(r"regexp_replace(x, '^\s*[1-4１-４][.．)）、:：\s]*', '')") + ") ELSE options END AS v FROM a"
)
ORACLES["txt19_furigana"] = "SELECT rid, " + _RUBY.format(_RUBY.format("question")) + " AS v FROM raw"
ORACLES["txt27_transcript"] = (
    r"WITH a AS (SELECT rid, list_reduce(list_filter([transcript, passage, question], lambda x: x IS NOT NULL AND NOT regexp_matches(x, '^(\s*[1-4１-４][.．)）、 ].*\n?)+$')), lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END) AS x FROM raw) "
    "SELECT rid, " + _STRIP.format(r"regexp_split_to_array(x, '\n\s*[-‐—–ー]{5,}\s*\n')[1]") + " AS v FROM a"
)

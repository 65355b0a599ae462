"""Prompt and response pairs whose response is no usable answer, with the kind of defect.

Each response field is judged by four readers:

* a pushdown parser over fences, brackets, quotations, markup tags and numbered lists: what is still open at the end, or a
  mark that announces more, means that the text broke off;
* greedy string tiling of its letters and digits with those of the prompt and its options: a text that tiles cover is a copy;
* script and word-shape checks: which share of its words, quotations aside, has the shape of the wanted language (Vietnamese);
* refusal grammars: who speaks, a denied ability or permission, and an act of answering, in several languages.

A text without a final stop that the parser finds closed may still end inside a sentence. How often its last two words end a
sentence and how often they go on is counted over all texts and joined to it: an ending that elsewhere nearly always goes on,
a last word that elsewhere hardly occurs but as a last one, or a short one that nowhere else follows the word before it, means
that it broke off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm import fold
from kumiki.llm.survivors import EMPTY_TALK, made_of
from kumiki.session import checkpointed, spread

ENDS_RARELY, GOES_ON = 0.02, 5
#: A label alone is no content; as letters and digits in lower case.
LABELS = "dịch bảndịch dịchnghĩa dịchcâu nghĩa ghichú giảithích chúthích note translation trans answer đápán trảlời câuhỏi đề đềbài question 問題 訳 翻訳 では".split()
NOTHING = [*EMPTY_TALK, *LABELS]
OPEN = dict(zip("（([{「『【〈《“‘«", "）)]}」』】〉》”’»"))
CLOSE = {b: a for a, b in OPEN.items()}
#: What the parser looks at: fences, quotation marks, tags and brackets.
SIGNS = re.compile("```|[\"<" + re.escape("".join(OPEN) + "".join(CLOSE)) + "]")
TAG = re.compile(r"<(/?)([A-Za-z][\w-]*)((?:\s[^<>]*)?)(/?)(>?)")
TERMINAL = ".。?？!！｡．"
#: Vietnamese words that open a phrase and end none.
DANGLING = set("và vì của với cho để rằng là thì mà nhưng nên hoặc hay bởi do tại từ đến ở trong ngoài trên dưới bằng như đã đang sẽ hãy những các một mỗi mọi nếu khi lúc tuy dù bị được cùng về theo".split()) - set("trong ngoài trên dưới về theo được đến hay cùng".split())
VIETNAMESE = re.compile("[ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]", re.I)
LATIN = re.compile("[A-Za-zÀ-ỿ]")
JAPANESE = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ々〆ー"
_JA = re.compile(f"[{JAPANESE}]")
_LETTERS = re.compile(r"[^\W\d_]+")
QUOTED = re.compile("「[^」]*」|『[^』]*』|“[^”]*”|\"[^\"]*\"|«[^»]*»|`[^`]*`")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+|[^\w\s]")
#: Vietnamese syllables in frequent use that have no mark, so that short plain sentences keep their language.
PLAIN = set("anh em con cho trong khi theo nhau hai ba năm sau trung ga kinh xem nghe hay ai cao xa ra đi sao tin thang giao nhanh quan tham gia cam trang hoa ban chia tay thay chung chi du khu mua thi thu tra vui văn yên an bao cung dung giang hoan huy lao nam ngay nghi nhanh nhi phong qua san sinh thanh theo tiên tung vai xin".split())

#: The lexicon of the refusal grammar, phrases by category.
LEXICON = {
    # S who speaks, P a softening, D a denied ability, permission or will, A an act of answering, R a request
    "S": "tôi|mình|em|chúng tôi|chúng em|trợ lý|trợ lý tự động|trợ lý ảo|trợ lý ai|ai|hệ thống|i|we|i'm|i’m|i am|we are|we're",
    "P": "rất tiếc|xin lỗi|e rằng|hiện|hiện tại",
    "D": "không thể|chưa thể|không được phép|chưa được phép|không có quyền|không có khả năng|không đủ khả năng|chưa đủ khả năng|không tiện|không biết cách|từ chối|xin phép không|xin phép từ chối|đành từ chối"
    "|unable|unable to|not able to|not allowed to|can not|cannot|can't|can’t|won't|won’t|must decline|must decline to|decline|decline to",
    "A": "dịch|trả lời|giải thích|giải đáp|đưa ra|cung cấp|giúp|hỗ trợ|thực hiện|xử lý|đáp ứng|phản hồi|bình luận|hoàn thành|trợ giúp"
    "|help|assist|provide|comply|translate|answer|explain|fulfil|fulfill|give|do|respond|offer|complete|discuss|helfen|übersetzen|beantworten",
    "R": "yêu cầu|yêu cầu này",
    # L lack of knowledge, B beyond the powers of
    "L": "không đủ thông tin|chưa đủ thông tin|không có đủ thông tin|chưa có đủ thông tin|không đủ dữ liệu|chưa đủ dữ liệu|không có đủ dữ liệu|chưa có đủ dữ liệu|không đủ ngữ cảnh|chưa đủ ngữ cảnh|không có đủ ngữ cảnh|chưa có đủ ngữ cảnh",
    "B": "ngoài khả năng của|ngoài phạm vi của|ngoài quyền hạn của|quá khả năng của|quá phạm vi của|quá quyền hạn của|ngoài khả năng xử lý của|ngoài phạm vi xử lý của|quá khả năng xử lý của|quá phạm vi xử lý của",
    # Z a speaker that is a tool; Q the same, which nobody writes but to decline
    "Z": "as an ai|as a language model|as an assistant|as an ai assistant|as an ai language model|as an automated assistant|as a virtual assistant",
    "Q": "với tư cách trợ lý|với tư cách là trợ lý|với tư cách một trợ lý|với tư cách là một trợ lý|với tư cách mô hình|với tư cách là mô hình|với tư cách một mô hình|với tư cách là một mô hình",
    # E and F an English apology, T what may follow it, N what isn't given, G that it isn't
    "E": "sorry",
    "F": "sorry but",
    "T": "no|this|that",
    "N": "explanation|translation|answer",
    "G": "can be given|could be given|can be provided|could be provided",
    # K whole refusals of other languages, H a denial that only an act completes
    "K": "tut mir leid|tut mir sehr leid|je suis désolé|je ne peux pas|maaf saya tidak|maaf, saya tidak",
    "H": "kann nicht|kann leider nicht|kann ich nicht|kann ich leider nicht",
}
#: Productions over the categories; W stands for the beginning of a sentence, w for any other word, a comma for a pause.
PRODUCTIONS = re.compile("S[PEF,]*S?[P,]*DA|S[P,]*L|BS|DAR|Q|Z[^W]{0,8}D|WS?(?:E,+|F,*)S|WS?[EF],*T|TNG|K|HA")
#: The same for languages without spaces, as patterns: an apology, a denied act.
DENIED = re.compile(
    r"申し訳(?:あり|ござい)ません.{0,30}(?:でき|かね|控え)|(?:お答え|回答|翻訳|説明|お手伝い|対応)(?:することは|は|を)?(?:でき(?:ません|かね|ない)|いたしかね|しかね|控え)|回答を控え|お答えを控え"
    r"|(?:抱歉|对不起|很遗憾).{0,20}(?:无法|不能)|죄송(?:합니다|하지만)|답변(?:할|드릴) 수 없"
)
_CATEGORY = {x: k for k, v in LEXICON.items() for x in v.split("|")}
_PHRASE = re.compile(rf"(?<!\w)({'|'.join(re.escape(x) for x in sorted(_CATEGORY, key=len, reverse=True))})(?!\w)|([,，;:])|([.!?。！？\n])|(\w[\w'’]*)")
_DENIES = re.compile(r"không|chưa|từ chối|quá |tư cách|ngoài |can|unable|not |won|decline|sorry|as an? |nicht|pas|tidak|xin lỗi|rất tiếc|désolé|maaf|leid|no ", re.I)


def refuses(text: str) -> bool:
    """Whether the refusal grammar derives a piece of the text. Words become categories, productions are found in their row."""
    if DENIED.search(text):
        return True
    if not _DENIES.search(text):
        return False
    row = "".join(_CATEGORY[m[1]] if m[1] else ",Ww"[m.lastindex - 2] for m in _PHRASE.finditer(text.strip().lower()))
    return PRODUCTIONS.search("W" + row) is not None


def broken(text: str, options: int = 0) -> bool:
    """Whether the pushdown parser ends with something open or announced."""
    s = text.rstrip()
    if not s:
        return False
    if s.endswith(("...", "…", "‥")) or s[-1] in ",、，､:：;；→<=/／-–—(（「『“[{+&" or s.endswith(("->", "=>")):
        return True
    stack: list[str] = []
    i = 0
    while m := SIGNS.search(s, i):
        i, c = m.end(), m.group()
        if c in ("```", '"'):
            if c in stack:
                del stack[len(stack) - 1 - stack[::-1].index(c) :]
            else:
                stack.append(c)
        elif c in OPEN and not (c == "‘" and m.start() and s[m.start() - 1].isalnum()):
            stack.append(c)
        elif c in CLOSE and CLOSE[c] in stack:  # crossed: what it closes and all above it
            del stack[len(stack) - 1 - stack[::-1].index(CLOSE[c]) :]
        elif c == "<" and (m := TAG.match(s, m.start())):
            closing, tag, _, empty, end = m.groups()
            if not end:
                stack.append("<")
            elif closing:
                if "<" + tag in stack:
                    del stack[len(stack) - 1 - stack[::-1].index("<" + tag) :]
            elif not empty and tag.lower() not in ("br", "hr", "img", "p", "li", "wbr"):
                stack.append("<" + tag)
            i = m.end()
    if stack:
        return True
    items = [int(x) for x in re.findall(r"(?:^|[/\n])\s*(\d{1,2})[.)]\s", s)]
    listed = len(items) > 1 and items == list(range(1, len(items) + 1))
    return bool(listed and options and s.startswith("1") and len(items) < options) or bool(re.search(r"(?:^|[/\n]\s*)\d{1,2}[.)]$", s) and listed)


def _free(marked: bytearray) -> list[int]:
    """How many unmarked characters follow from each place on."""
    out = [0] * (len(marked) + 1)
    for i in range(len(marked) - 1, -1, -1):
        out[i] = 0 if marked[i] else out[i + 1] + 1
    return out


def tiles(text: str, source: str, least: int = 5) -> int:
    """Characters of `text` that greedy string tiling covers with pieces of `source`, longest first, none shorter than `least`.

    The greatest length of a common piece is found by halving, over all places of both; marked characters are not used again.
    """
    if len(text) < least or len(source) < least:
        return len(text) if text and text in source else 0
    used, taken, total = bytearray(len(text)), bytearray(len(source)), 0
    top = min(len(text), len(source))
    while top >= least:
        own, other = _free(used), _free(taken)

        def places(k: int) -> dict[int, list[int]]:
            at: dict[int, list[int]] = {}
            for j in range(len(source) - k, -1, -1):
                if other[j] >= k:
                    at.setdefault(hash(source[j : j + k]), []).append(j)  # the last is the first place
            return at

        def common(k: int) -> bool:
            at = places(k)
            for i in range(len(text) - k + 1):
                if own[i] >= k:
                    piece = text[i : i + k]
                    if (js := at.get(hash(piece))) and source.startswith(piece, js[-1]):
                        return True
            return False

        low = least - 1
        while low < top:
            k = (low + top + 1) // 2
            low, top = (k, top) if common(k) else (low, k - 1)
        if top < least:
            return total
        at = places(top)
        for i in range(len(text) - top + 1):
            if own[i] < top or used[i] or used[i + top - 1]:
                continue
            piece = text[i : i + top]
            js = at.get(hash(piece), [])
            while js and (taken[js[-1]] or taken[js[-1] + top - 1]):  # this round's pieces have one length
                js.pop()
            if js and source.startswith(piece, js[-1]):
                j = js.pop()
                used[i : i + top] = taken[j : j + top] = b"\x01" * top
                total += top
        top -= 1
    return total


def coverable(text: str, source: str, least: int = 5) -> int:
    """Characters of `text` inside a common piece of `least` characters: no tiling covers more."""
    have = {source[j : j + least] for j in range(len(source) - least + 1)}
    total = end = 0
    for i in range(len(text) - least + 1):
        if text[i : i + least] in have:
            total += i + least - max(end, i)
            end = i + least
    return total


def copied(t: str, q: str, options: list[str]) -> bool:
    """Whether a text is the question again, with no more than an option and a label beside it; all as letters and digits."""
    if len(q) < 4 or not t:
        return False
    if q in t:
        rest = t.replace(q, "", 1)
        return len(rest) <= 12 or any(len(rest.replace(o, "", 1)) <= 12 for o in options if o and o in rest)
    extra = max([0, *(len(o) for o in options if o and o in t)])
    spare = max(4, 0.1 * len(t))
    if len(t) - len(q) - extra > spare or len(t) >= 5 and len(q) >= 5 and coverable(q, t) < 0.75 * len(q):
        return False  # tiles can't reach what is asked below
    both = tiles(t, q)
    return both >= 0.75 * len(q) and len(t) - both - extra <= spare


def foreign(text: str) -> bool:
    """Whether a text, quotations aside, is in a language other than Vietnamese. Texts without words are in none."""
    bare = QUOTED.sub(" ", text)
    japanese = len(_JA.findall(bare))
    every = _LETTERS.findall(_JA.sub(" ", bare) if japanese else bare)
    latin = [w for w in every if LATIN.match(w)]
    marks = [VIETNAMESE.search(w) is not None for w in latin]
    if len(latin) < len(every) and sum(len(w) for w in every if not LATIN.match(w)) > sum(len(w) for w, m in zip(latin, marks) if m):
        return True
    weighed = [(w, m) for w, m in zip(latin, marks) if m or not w[0].isupper()]
    strong = sum(m for _, m in weighed)
    if not strong:
        return japanese > 0 or len(latin) > 1 and sum(map(len, latin)) > 6
    if len(weighed) >= 4 and sum(m or w in PLAIN for w, m in weighed) < 0.45 * len(weighed):
        return True
    return japanese > 12 and len(latin) < 3 and strong < 2


def words(text: str) -> list[str]:
    return ["9" if w.isdigit() else w.lower() if w[0].isalpha() else w for w in WORD.findall(text)]


def judge(text: str | None, question: str, options: list[str], must: bool) -> str | None:
    """The defect of one field, 'open?' where its ending must be weighed, or None. `must`: the field may not be empty."""
    return _judge(text, fold.folded(text), fold.folded(question), [fold.folded(o) for o in options], must)


def _judge(text: str | None, f: str, question: str, options: list[str], must: bool) -> str | None:
    """`judge`, with the letters and digits of the text, the question and the options."""
    if not f or made_of(f, NOTHING):
        return "empty" if must else None
    if refuses(text):
        return "refusal"
    if copied(f, question, options):
        return "copy"
    if foreign(text):
        return "language"
    if broken(text, len(options)):
        return "truncated"
    s = text.rstrip().rstrip("」』”\"）)]*_ ")
    if not s or s[-1] in TERMINAL or not s[-1].isalnum() or s[-1].isdigit() or _JA.match(s[-1]):
        return None
    return "truncated" if words(s[-200:] if " " in s[-200:-100] else s)[-1] in DANGLING else "open?"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"oid": [], "field": [], "defect": [], "w1": [], "w2": [], "short": []}
        col = {c: b.column(c).to_pylist() for c in ("oid", "trans", "note", "question", "options")}
        lists = [[o for o in x or () if o] for x in col["options"]]
        every = fold.folded_many([*col["trans"], *col["note"], *col["question"], *(o for x in lists for o in x)])
        n, at = b.num_rows, 3 * b.num_rows
        for i, oid in enumerate(col["oid"]):
            opts, at = every[at : at + len(lists[i])], at + len(lists[i])
            for field, text in enumerate((col["trans"][i], col["note"][i])):
                d = _judge(text, every[field * n + i], every[2 * n + i], opts, field == 0)
                if d:
                    tail = (text or "").rstrip().rstrip("」』”\"）)]*_ ")
                    last = ["", "", *words(tail[-200:] if " " in tail[-200:-100] else tail)][-2:] if d == "open?" else (None, None)
                    for k, v in zip(out, (oid, field, d, *last, d == "open?" and len(last[1]) < 5 and tail.endswith(last[1]))):
                        out[k].append(v)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, ends, goes, bare): how often two words are followed by punctuation or by nothing, by a word, and by nothing. w1 is
    null for w2 alone."""
    for b in batches:
        ends: Counter = Counter()
        goes: Counter = Counter()
        bare: Counter = Counter()
        for c in ("trans", "note"):
            for text in b.column(c).to_pylist():
                w = words(text or "")
                for x, y, z in zip(["", *w], w, [*w[1:], None]):
                    if y[0].isalnum():
                        if z is None or not z[0].isalnum():
                            ends[x, y] += 1
                            ends[None, y] += 1
                            bare[None, y] += z is None
                        else:
                            goes[x, y] += 1
                            goes[None, y] += 1
        keys = [*(ends | goes)]
        cols = ([k[0] for k in keys], [k[1] for k in keys], [ends[k] for k in keys], [goes[k] for k in keys], [bare[k] for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["w1", "w2", "ends", "goes", "bare"])


def defects(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """(oid, defect): each defective row of `answers` (oid, id, trans, note), once; `prompts` has id, question, options, built_at.

    Of several prompts of an id the one built last counts. A row whose prompt is missing is judged without it. A field's
    defect is the first of empty (trans only), refusal, copy, language, truncated; trans goes before note. A null, empty or
    blank trans is empty; such a note is no defect.
    """
    known = prompts.where("id IS NOT NULL").groupBy(F.col("id").alias("k")).agg(
        F.max(F.struct(F.coalesce("built_at", F.expr("timestamp_ntz'0001-01-01'")).alias("t"), "question", "options")).alias("p")
    )
    rows = answers.select("oid", "id", "trans", "note").join(known, F.expr("id = k"), "left")
    rows = checkpointed(rows.select("oid", "trans", "note", F.col("p.question").alias("question"), F.col("p.options").alias("options")))
    seen = checkpointed(spread(rows, "oid").mapInArrow(_judged, "oid long, field int, defect string, w1 string, w2 string, short boolean"))
    unsure = seen.where("defect = 'open?'")
    counts = spread(rows.select("trans", "note")).mapInArrow(_endings, "w1 string, w2 string, ends long, goes long, bare long")
    counts = checkpointed(counts.groupBy("w1", "w2").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"), F.sum("bare").alias("bare")))
    two = counts.where("w1 IS NOT NULL").drop("bare")
    one = counts.where("w1 IS NULL").select("w2", (F.col("ends") + F.col("goes") - F.col("bare")).alias("whole"), "bare")
    cut = (
        unsure.join(two, ["w1", "w2"])
        .join(one, "w2")
        .where(f"whole <= bare OR (short AND ends + goes = 1) OR (goes >= {GOES_ON} AND (ends - 1) < {ENDS_RARELY} * (ends - 1 + goes))")
        .select("oid", "field", F.lit("truncated").alias("defect"))
    )
    sure = seen.where("defect <> 'open?'").select("oid", "field", "defect")
    return sure.unionByName(cut).groupBy("oid").agg(F.min(F.struct("field", "defect")).alias("d")).select("oid", F.col("d.defect").alias("defect"))

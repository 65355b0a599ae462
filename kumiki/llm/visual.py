"""One consistent form for text that looks the same: compatibility forms, ignorable characters, odd spaces, look-alike signs.

Each text is taken apart in three steps:

1. Ignorable characters go, odd spaces become the ordinary one, and everything but the usual full-width signs takes its
   compatibility composition (NFKC).
2. Where a sign that has look-alikes stands beside letters, each place of the stretch gets a lattice of the signs that look
   like it; Viterbi's algorithm finds the path of the greatest score. A step of the path scores the joint count of its two
   signs in the whole corpus, backed off to the counts of their scripts; a change of alphabet costs a fixed amount, so that a
   word keeps to one script; a sign that
   isn't the written one costs a fixed amount.
3. A field is affected if step 1 or 2 changed it, or if a word still mixes alphabets.

The counts are made over all texts. They are kept only for pairs with a sign of the look-alike tables, other signs by script,
so their number is bounded by the tables and not by the texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm.fold import codes
from kumiki.session import spread

#: Signs that look like another, each row written first and what it looks like second.
LOOKS_LATIN = {
    "аеорсухіјѕһԁԛԝѵӏ": "aeopcyxijshdqwvl",
    "АВЕКМНОРСТУХІЈЅѴԚԜҮ": "ABEKMHOPCTYXIJSVQWY",
    "οναικρυϲϳ": "ovaikpucj",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϜϹ": "ABEZHIKMNOPTYXFC",
    "ոցսօհզյտԼՏՕՍ": "nguohqjmLSOU",
    "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏢᏟᏞᏦᏴ": "DRTAJEWMHGZSVPCLKB",
    "ɑɡıʏʟ": "agiyl",
}
#: Signs of Japanese words that look alike, one group each.
LOOKS_JAPANESE = ["カ力", "ロ口", "ニ二", "エ工", "タ夕", "ト卜", "ハ八", "オ才", "チ千", "ヘへ", "ベべ", "ペぺ", "リり", "ー一‐‑‒–—―−－─-"]
#: Full-width signs in usual use, which compatibility composition would change.
USUAL = "　。、・「」（）：？＿★！，．；～［］｛｝…‥゛゜"
#: Signs of CJK Radicals Supplement without a decomposition, and the ideographs they look like.
RADICALS = str.maketrans("⺌⺍⺕⺗⺠⺩⺪⺬⺮⺯⺶⺷⺹⺼⻁⻂⻃⻄⻈⻌⻎⻏⻑⻒⻓⻘⻝⻟⻤⻨⻩⻫⻭⻯⻲", "小小彐心民王疋示竹糸羊羊老月虎衣西西讠辶辶阝長長长青食飠鬼麦黄斉歯竜亀")

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
SPACE = re.compile("[   -     ]")
MARK = re.compile("[̀-゙゚ͯ]")
COST = 2.5
LEAST = 0.5
#: What a change of alphabet inside a word costs.
MIXED = 12.0
ALPHABETS = {"latin", "cyrillic", "greek", "armenian", "cherokee"}

TO_LATIN = {a: b for written, latin in LOOKS_LATIN.items() for a, b in zip(written, latin, strict=True)}
ALIKE: dict[str, str] = {a: a + b for a, b in TO_LATIN.items()}
for _g in LOOKS_JAPANESE:
    ALIKE |= {c: c + "".join(x for x in _g if x != c and x not in "‐‑‒–—―−－─-") for c in _g}
_SET = "".join(map(re.escape, ALIKE))
_KATA, _HAN = "ァ-ヺー", "一-鿿々㐀-䶿"
_LETTER = "A-Za-zÀ-ɏḀ-ỿ"
_FOREIGN = "".join(map(re.escape, TO_LATIN))
#: A stretch worth a lattice: one with a foreign letter that looks Latin, or a Japanese sign in a place its look-alikes take.
STRETCH = re.compile(
    f"[{_LETTER}Ͱ-ϿЀ-ԯԱ-֏Ꭰ-᏿]*[{_FOREIGN}][{_LETTER}Ͱ-ϿЀ-ԯԱ-֏Ꭰ-᏿]*"
    f"|(?<=[{_KATA}])[力口二工夕卜八才千一へべぺり‐‑‒–—―−－─\\-]+|[力口二工夕卜八才千一へべぺり]+(?=[{_KATA}])"
    f"|(?<=[{_HAN}])[カロニエタトハオチヘベペリー]+(?![{_KATA}])|(?<=[ぁ-ゖ])[ヘベペリカロニエタトハオチー](?![{_KATA}])"
    f"|(?<![{_KATA}])[カロニエタトハオチヘベペリー]+(?=[{_HAN}])"
)
ALPHABET = re.compile("[^\\W\\d_぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]{2,}")


def _script(c: str) -> str:
    o = ord(c)
    if 0x3041 <= o <= 0x3096:
        return "hira"
    if 0x30A1 <= o <= 0x30FA or o == 0x30FC:
        return "kata"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or o == 0x3005:
        return "han"
    if c.isalpha():
        return unicodedata.name(c, "?").split()[0].lower()
    return "digit" if c.isdigit() else "sign"


_scripts: dict[str, str] = {}
_KEPT = set(ALIKE) | set("".join(ALIKE.values()))


def script(c: str) -> str:
    if c not in _scripts:
        _scripts[c] = _script(c)
    return _scripts[c]


def symbol(c: str) -> str:
    """`c` itself if the tables or the Latin or kana blocks hold it, else its script: a bounded set."""
    return c if c in _KEPT or c < "ɐ" or "぀" <= c < "㄀" else script(c)


def plain(text: str) -> str:
    """Step 1: without ignorable characters, odd spaces and compatibility forms. Usual full-width signs stay."""
    text = SPACE.sub(" ", INVISIBLE.sub("", text))
    if text.isascii():
        return text
    if unicodedata.is_normalized("NFKC", text):
        return text.translate(RADICALS)
    parts = re.split(f"([{re.escape(USUAL)}]+)", text)
    parts[::2] = [unicodedata.normalize("NFKC", p) for p in parts[::2]]
    return "".join(parts).translate(RADICALS)


class Scores:
    """Joint counts of neighbouring symbols and of their scripts, as log scores."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs = pairs
        by_script: Counter = Counter()
        for (a, b), n in pairs.items():
            by_script[self._of(a), self._of(b)] += n
        total = max(1, sum(by_script.values()))
        self.back = {k: n / total for k, n in by_script.items()}

    @staticmethod
    def _of(s: str) -> str:
        return script(s) if len(s) == 1 else s

    def step(self, a: str, b: str) -> float:
        p, q = script(a), script(b)
        back = self.back.get((p, q), 0.0)
        return math.log(self.pairs.get((symbol(a), symbol(b)), 0) + LEAST * back + 1e-4) - (MIXED if p != q and p in ALPHABETS and q in ALPHABETS else 0)

    def settle(self, text: str) -> str:
        """Step 2: the best path through the lattice of each stretch, with the signs beside it as they are."""
        return STRETCH.sub(lambda m: self._path(text, m), text) if STRETCH.search(text) else text

    def _path(self, text: str, m: re.Match) -> str:
        word = m.group()
        before = text[m.start() - 1] if m.start() else "\n"
        after = text[m.end()] if m.end() < len(text) else "\n"
        best = {before: (0.0, "")}
        for c in word:
            best = {
                x: max((s + self.step(p, x) - (0 if x == c else COST), way + x) for p, (s, way) in best.items())
                for x in ALIKE.get(c, c)
            }
        return max((s + self.step(p, after), way) for p, (s, way) in best.items())[1]


def mixed(text: str) -> bool:
    """Whether a word has letters of two alphabets."""
    return any(len({script(c) for c in w if c.isalpha()}) > 1 for w in ALPHABET.findall(text) if not w.isascii())


class Normalizer:
    """`of(text)` is the consistent form; `affected(text)` says whether the text holds a look-alike or hidden character."""

    def __init__(self, scores: Scores):
        self.scores, self.seen = scores, {}

    def of(self, text: str | None) -> str | None:
        if text is None or text.isascii() and not INVISIBLE.search(text):
            return text
        if text not in self.seen:
            if len(self.seen) > 20_000:
                self.seen.clear()
            self.seen[text] = self.scores.settle(plain(text))
        return self.seen[text]

    def affected(self, text: str | None) -> bool:
        if not text:
            return False
        new = self.of(text)
        return new != text or MARK.search(text) is not None or mixed(new)

    def all_of(self, texts: list[str | None]) -> list[str | None]:
        """`of` each text; only those with anything unusual are looked at one by one."""
        out = list(texts)
        for i in np.flatnonzero(suspects([x or "" for x in texts])):
            out[i] = self.of(texts[i])
        return out


#: Classes of characters for a first look at many texts at once.
_SLOW, _KATAKANA, _HANZI, _HIRA, _AFTER, _KANA = 1, 2, 4, 8, 16, 32
_first: dict = {}


def _odd(c: str) -> bool:
    """Whether steps 1 or 3 could look at a character: compatibility forms, marks, jamo, letters of other alphabets than Latin."""
    if c in USUAL:
        return False
    if INVISIBLE.match(c) or SPACE.match(c) or ord(c) in RADICALS or c in TO_LATIN:
        return True
    if c.isascii():
        return False
    if unicodedata.category(c)[0] == "M" or MARK.match(c) or "ᄀ" <= c <= "ᇿ" or unicodedata.normalize("NFKC", c) != c:
        return True
    return ALPHABET.match(2 * c) is not None and script(c) != "latin"


def _classes() -> np.ndarray:
    """Classes of the basic plane; all other characters count as slow."""
    if "classes" not in _first:
        kata, han, hira = re.compile(f"[{_KATA}]"), re.compile(f"[{_HAN}]"), re.compile("[ぁ-ゖ]")
        after, kana = set("力口二工夕卜八才千一へべぺり‐‑‒–—―−－─-"), set("カロニエタトハオチヘベペリー")
        t = np.zeros(0x10001, np.uint8)
        t[0x10000] = _SLOW
        for o in range(0x10000):
            c = chr(o)
            t[o] = _SLOW * _odd(c) | _KATAKANA * bool(kata.match(c)) | _HANZI * bool(han.match(c)) | _HIRA * bool(hira.match(c)) | _AFTER * (c in after) | _KANA * (c in kana)
        _first["classes"] = t
    return _first["classes"]


def suspects(texts: list[str]) -> np.ndarray:
    """Which texts hold anything that steps 1 to 3 could change or name. All others stay as they are.

    The places that STRETCH could match are found by the classes of three neighbours, never too few of them.
    """
    hit = np.zeros(len(texts), bool)
    if not texts:
        return hit
    c = codes("\n\n" + "\n\n".join(texts) + "\n\n")
    t = _classes()[np.minimum(c, 0x10000)]
    a, b, d = t[:-2], t[1:-1], t[2:]
    on = (b & _SLOW) > 0
    on |= (b & _AFTER > 0) & ((a | d) & _KATAKANA > 0)
    on |= (b & _KANA > 0) & ((a & (_HANZI | _HIRA) > 0) & ((d & _KATAKANA == 0) | (d & _KANA > 0)) | (d & _HANZI > 0) & ((a & _KATAKANA == 0) | (a & _KANA > 0)))
    places = np.flatnonzero(on) + 1
    starts = np.cumsum([2, *(len(x) + 2 for x in texts[:-1])])
    hit[np.searchsorted(starts, places, "right") - 1] = True
    return hit


def _symbols() -> tuple[np.ndarray, list[str]]:
    """The number of each character's symbol in the basic plane, and the symbols; a number for all others is taken apart."""
    if "symbols" not in _first:
        names: dict[str, int] = {}
        t = np.fromiter((names.setdefault(symbol(chr(o)), len(names)) for o in range(0x10000)), np.int64, 0x10000)
        _first["symbols"] = t, names
    return _first["symbols"]


def _numbered(c: np.ndarray) -> np.ndarray:
    t, names = _symbols()
    out = t[np.minimum(c, 0xFFFF)]
    for o in np.unique(c[c > 0xFFFF]).tolist():
        out[c == o] = names.setdefault(symbol(chr(o)), len(names))
    return out


def _count(fields: list[str], lists: tuple[bool, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        wide = 1 << 20
        for b in batches:
            texts: list[str] = []
            for f, many in zip(fields, lists):
                col = b.column(f).to_pylist()
                texts += [t for x in col for t in x or () if t] if many else [x for x in col if x]
            for i in np.flatnonzero(suspects(texts)):
                texts[i] = plain(texts[i])
            if texts:
                s = _numbered(codes("\n" + "\n".join(texts) + "\n"))
                pairs, n = np.unique(s[:-1] * wide + s[1:], return_counts=True)
                for k, m in zip(pairs.tolist(), n.tolist()):
                    seen[k] += m
        if seen:
            names = [*_symbols()[1]]
            yield pa.RecordBatch.from_pydict({"a": [names[k // wide] for k in seen], "b": [names[k % wide] for k in seen], "n": list(seen.values())})

    return run


def scores(rows: DataFrame, fields: list[str], list_fields: tuple[str, ...] = ()) -> Scores:
    """Scores from all texts of `fields`. The driver gets one row for each pair of symbols, a number bounded by `symbol`."""
    lists = tuple(f in list_fields for f in fields)
    pairs = spread(rows.select(*fields)).mapInArrow(_count(fields, lists), "a string, b string, n long")
    return Scores({(r["a"], r["b"]): r["n"] for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()})


def normalized(rows: DataFrame, fields: list[str], list_fields: tuple[str, ...] = (), model: Scores | None = None) -> DataFrame:
    """`rows` with each of `fields` in its consistent form and `affected`, the array of the names of the fields it changed.

    Nulls stay null, empty and blank texts stay as they are; tabs and line ends are kept. Other columns pass through.
    """
    lists = tuple(f in list_fields for f in fields)
    model = model or scores(rows, fields, list_fields)
    shared = rows.sparkSession.sparkContext.broadcast(model.pairs)  # bounded by the tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Normalizer(Scores(shared.value))
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns))
            hit: list[list[str]] = [[] for _ in range(b.num_rows)]
            for f, many in zip(fields, lists):
                col = cols[f].to_pylist()
                flat = [t or "" for x in col for t in x or ()] if many else [x or "" for x in col]
                odd = np.flatnonzero(suspects(flat))
                if not len(odd):
                    continue
                of = np.repeat(np.arange(len(col)), [len(x or ()) for x in col]) if many else None
                for i in odd.tolist():
                    k = int(of[i]) if many else i
                    if n.affected(flat[i]) and hit[k][-1:] != [f]:
                        hit[k].append(f)
                    if not many:
                        col[k] = n.of(flat[i])
                if many:
                    for k in np.unique(of[odd]).tolist():
                        col[k] = [n.of(t) for t in col[k]]
                cols[f] = pa.array(col, cols[f].type)
            cols["affected"] = pa.array(hit, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "affected") + ", affected array<string>"
    return spread(rows.drop("affected")).mapInArrow(run, schema)

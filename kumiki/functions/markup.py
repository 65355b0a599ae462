"""TXT14, ARR4, ARR5, WIN12: what needs a parser: HTML to text, tables with row spans, embedded data."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_DROP = {"rt", "rp", "script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "li", "tr", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "blockquote"}
_CELL = {"td", "th"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.cells = 0

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.hidden += 1
        elif tag == "br" or tag in _BLOCK:
            self.out.append("\n")
            self.cells = 0
        elif tag in _CELL:
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag == "u":
            self.out.append("＿")

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCK:
            self.out.append("\n")
        elif tag == "u":
            self.out.append("＿")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def to_text(page: str) -> str:
    """Text of a page: ruby readings, scripts and styles dropped, blocks and breaks as lines, cells by bars, underlines marked."""
    if "<" not in page and "&" not in page:
        return page.strip()
    p = _Text()
    p.feed(page)
    p.close()
    text = re.sub(r"[ \t ]+", " ", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


@F.pandas_udf(StringType())
def _html_text(s: pd.Series) -> pd.Series:
    return s.map(to_text, na_action="ignore")


def html_text(c):
    """TXT14 as a column; null stays null."""
    return _html_text(F.col(c) if isinstance(c, str) else c)


def grid(page: str) -> list[list[str]]:
    """WIN12: rows of a table, cells that span rows carried down."""
    rows: list[list[str]] = []
    carry: dict[int, tuple[int, str]] = {}
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|$)", page):
        cells = re.findall(r"(?is)<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]>|$)", row)
        out: list[str] = []
        it = iter(cells)
        col = 0
        while True:
            if col in carry:
                n, v = carry.pop(col)
                out.append(v)
                if n > 1:
                    carry[col] = (n - 1, v)
                col += 1
                continue
            cell = next(it, None)
            if cell is None:
                if any(k > col for k in carry):
                    out.append("")
                    col += 1
                    continue
                break
            v = to_text(cell[1])
            span = re.search(r"rowspan\s*=\s*[\"']?(\d+)", cell[0], re.I)
            if span and int(span.group(1)) > 1:
                carry[col] = (int(span.group(1)) - 1, v)
            out.append(v)
            col += 1
        rows.append(out)
    return rows


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_grid(s: pd.Series) -> pd.Series:
    return s.map(grid, na_action="ignore")


def structure(page: str) -> str | None:
    """WIN12: the first table of a page as one text: cells of a row joined by plus signs, rows by slashes, each row once.

    A cell that spans rows is appended to those of the next rows that have no spanning cell themselves.
    """
    rows: list[str] = []
    shared, left = "", 0
    table = re.search(r"(?is)<table\b.*?</table>", page)
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|$)", table[0] if table else ""):
        cells = [(re.search(r"rowspan\s*=\s*[\"']?(\d+)", a, re.I), to_text(v)) for a, v in re.findall(r"(?is)<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]>|$)", row)]
        texts = [v for _, v in cells]
        spans = [(int(m[1]), v) for m, v in cells if m]
        if spans:
            left, shared = spans[-1][0] - 1, spans[-1][1]
        elif left > 0:
            texts.append(shared)
            left -= 1
        if any(texts):
            rows.append(" + ".join(v for v in texts if v))
    return " / ".join(dict.fromkeys(rows)) or None


@F.pandas_udf(StringType())
def table_structure(s: pd.Series) -> pd.Series:
    return s.map(structure, na_action="ignore")


def flight(page: str) -> str | None:
    """ARR4: the data that a page pushes in pieces, `push([1, "..."])`, put together in the order of the page."""
    parts = re.findall(r'\.push\(\[\s*1\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\)', page, re.S)
    return "".join(map(json.loads, parts)) if parts else None


@F.pandas_udf(StringType())
def flight_data(s: pd.Series) -> pd.Series:
    return s.map(flight, na_action="ignore")


def balanced(text: str, start: int = 0) -> str | None:
    """ARR4: the first balanced brace expression at or after `start`, strings respected."""
    i = text.find("{", start)
    if i < 0:
        return None
    depth, quoted, j = 0, None, i
    while j < len(text):
        c = text[j]
        if quoted:
            if c == "\\":
                j += 1
            elif c == quoted:
                quoted = None
        elif c in "\"'":
            quoted = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[i : j + 1]
        j += 1
    return None


@F.pandas_udf(StringType())
def embedded_json(s: pd.Series) -> pd.Series:
    """ARR4: the first balanced JSON object of a page, entities resolved."""
    return s.map(lambda x: balanced(html.unescape(x)), na_action="ignore")


#: Names that wrap a value, and names that wrap a list of values.
_WRAPPERS, _LISTS = {"ShallowReactive", "Reactive", "Ref", "ShallowRef", "EmptyRef"}, {"Set", "Map"}


def hydrate(flat: list) -> object:
    """ARR5: the tree of a flattened reference array: numbers point to entries, entry 0 is the root; cycles end in None.

    What is no number inside a list or an object stands for itself. Wrappers give what they wrap, sets and maps a list.
    """
    done: dict[int, object] = {}
    busy: set[int] = set()

    def inner(x: object) -> object:
        return get(x) if isinstance(x, int) and not isinstance(x, bool) else x

    def built(v: object) -> object:
        if isinstance(v, dict):
            return {a: inner(b) for a, b in v.items()}
        if not isinstance(v, list):
            return v
        name = v[0] if v and isinstance(v[0], str) else None
        if name in _WRAPPERS:
            return inner(v[1]) if len(v) > 1 else None
        return [inner(x) for x in (v[1:] if name in _LISTS else v)]

    def get(k: int) -> object:
        if not 0 <= k < len(flat) or k in busy:
            return None
        if k not in done:
            busy.add(k)
            done[k] = built(flat[k])
            busy.discard(k)
        return done[k]

    return get(0) if flat else None


@F.pandas_udf(StringType())
def hydrated(s: pd.Series) -> pd.Series:
    """ARR5 as a column of JSON; what is no JSON array is null."""

    def one(x: str) -> str | None:
        try:
            v = json.loads(x)
        except ValueError:
            return None
        return json.dumps(hydrate(v), ensure_ascii=False, sort_keys=True) if isinstance(v, list) else None

    return s.map(one, na_action="ignore")


def walk(value: object, path: str = "$") -> list[tuple[str, str]]:
    """ARR7: every scalar of a nested document with its path, in document order."""
    out: list[tuple[str, str]] = []
    todo = [(path, value)]
    while todo:
        p, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{p}.{k}", x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{p}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            out.append((p, v if isinstance(v, str) else json.dumps(v)))
    return out


@F.pandas_udf(ArrayType(StructType([StructField("path", StringType()), StructField("text", StringType())])))
def walked(s: pd.Series) -> pd.Series:
    """ARR7 as a column; what is no JSON has no paths."""

    def one(x: str | None) -> list[dict]:
        try:
            return [{"path": p, "text": t} for p, t in walk(json.loads(x))] if x else []
        except ValueError:
            return []

    return s.map(one)

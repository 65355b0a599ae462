"""Letters and digits of texts, without building them: a skip-and-fold table over code points and what reads through it.

TABLE[c] is the lower-case code point of c, or 0 where c is white space, a control character, punctuation or a symbol (general
categories Z, C, P, S). Texts run through it as flat arrays of code points in slices of bounded size; each kept code point
adds to a polynomial hash of its text. No canonical string is made.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_state: dict = {}


def table(top: int = 0) -> np.ndarray:
    """The skip-and-fold table up to code point `top` at least, made once in each process: the basic plane, or all planes."""
    t = _state.get("table")
    if t is None or len(t) <= top:
        size = 0x10000 if top < 0x10000 else sys.maxunicode + 1
        t = np.zeros(size, np.uint32)
        for c in range(size):
            if unicodedata.category(s := chr(c))[0] not in "ZPSC":
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _state["table"] = t
    return t


def _read(c: np.ndarray) -> np.ndarray:
    """Code points through the table; 0 where they are skipped."""
    return table(int(c.max()) if len(c) else 0)[c]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _state.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _state[base] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that fill a slice; a text that is longer has a range of its own."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + len(texts[j] or "") <= SLICE):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: two 64-bit hashes of its letters and digits, and their number. None is as the empty text."""
    n = len(texts)
    h1, h2, kept = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for i, j in _slices(texts):
        if j == i + 1 and len(texts[i] or "") > SLICE:
            for k in range(0, len(texts[i]), SLICE):
                _add([texts[i][k : k + SLICE]], slice(i, j), h1, h2, kept)
        else:
            _add(texts[i:j], slice(i, j), h1, h2, kept)
    return mix(h1 ^ kept.view(np.uint64)), mix(h2 + kept.view(np.uint64)), kept


def _add(part: list[str | None], at: slice, h1: np.ndarray, h2: np.ndarray, kept: np.ndarray) -> None:
    sizes = np.fromiter((len(x or "") for x in part), np.int64, len(part))
    f = _read(codes("".join(x or "" for x in part)))
    of = np.repeat(np.arange(len(part)), sizes)
    on = f > 0
    f, of = f[on].astype(np.uint64), of[on]
    count = np.bincount(of, minlength=len(part))
    place = np.arange(len(f)) - np.repeat(np.cumsum(count) - count, count) + kept[at][of]
    top = int(place.max()) + 1 if len(place) else 0
    starts = (np.cumsum(count) - count)[count > 0]
    for base, h in zip(BASES, (h1, h2)):
        if len(starts):
            h[at][count > 0] += np.add.reduceat((f + np.uint64(1)) * _powers(base, top)[place], starts)
    kept[at] += count


def same(a: str | None, b: str | None) -> bool:
    """Whether two texts have the same letters and digits: two pointers, each skipping what the table drops, block by block."""
    if a == b:
        return True
    left, right = codes(a or ""), codes(b or "")
    i = j = 0
    p = q = np.empty(0, np.uint32)
    while True:
        while not len(p) and i < len(left):
            p, i = _read(left[i : i + 4096]), i + 4096
            p = p[p > 0]
        while not len(q) and j < len(right):
            q, j = _read(right[j : j + 4096]), j + 4096
            q = q[q > 0]
        if not len(p) or not len(q):
            return len(p) == len(q)
        n = min(len(p), len(q))
        if not np.array_equal(p[:n], q[:n]):
            return False
        p, q = p[n:], q[n:]


def letters(text: str | None) -> np.ndarray:
    """The folded code points of one text."""
    f = _read(codes(text or ""))
    return f[f > 0]


def folded(text: str | None) -> str:
    """Letters and digits as a string, for what needs their sequence and not only their identity."""
    return letters(text).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def folded_many(texts: list[str | None]) -> list[str]:
    """`folded` of each text, many at a time."""
    out: list[str] = []
    for i, j in _slices(texts):
        part = [x or "" for x in texts[i:j]]
        f = _read(codes("".join(part)))
        on = f > 0
        ends = np.cumsum(on)[np.cumsum(np.fromiter(map(len, part), np.int64, len(part))) - 1] if len(f) else ()
        whole, at = f[on].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), 0
        for x, end in zip(part, ends):
            end = end if x else at
            out.append(whole[at:end])
            at = end
        out.extend([""] * (len(part) if not len(f) else 0))
    return out


def same_list(x: list[str | None], y: list[str | None]) -> bool:
    """Whether two lists have the same parts in any order: parts are paired by their hashes and each pair is compared."""
    if len(x) != len(y):
        return False
    left, right = ([*zip(*(h.tolist() for h in hashes(z)[:2]))] for z in (x, y))
    if sorted(left) != sorted(right):
        return False
    free: dict[tuple, list[int]] = {}
    for j, k in enumerate(right):
        free.setdefault(k, []).append(j)
    for i, k in enumerate(left):
        for at, j in enumerate(free[k]):  # more than one only where parts repeat or hashes collide
            if same(x[i], y[j]):
                del free[k][at]
                break
        else:
            return False
    return True


def same_row(a: tuple, b: tuple, lists: tuple[bool, ...]) -> bool:
    """Whether two rows agree in every field, fields marked in `lists` in any order of their parts."""
    return all(x == y or (same_list(list(x or []), list(y or [])) if many else same(x, y)) for x, y, many in zip(a, b, lists))


def digest(text: str | None) -> bytes:
    """A 256-bit digest of a text's letters and digits, fed block by block."""
    d, n, c = hashlib.sha256(), 0, codes(text or "")
    for i in range(0, len(c), 4096):
        f = _read(c[i : i + 4096])
        f = f[f > 0]
        n += len(f)
        d.update(f.astype("<u4").tobytes())
    d.update(n.to_bytes(8, "little"))
    return d.digest()


def row_digest(row: tuple, lists: tuple[bool, ...]) -> bytes:
    """A 256-bit digest of a row's fields, for rows whose 128-bit fingerprints collide; a list's digests go in order of size."""
    d = hashlib.sha256()
    for x, many in zip(row, lists):
        for o in sorted(digest(o) for o in (x or [])) if many else [digest(x)]:
            d.update(o)
        d.update(b"|")
    return d.digest()

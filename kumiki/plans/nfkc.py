"""Compatibility composition for SQL engines that have only the canonical one, made from the Unicode data of the standard library.

Signs whose compatibility form is one sign are translated; canonical composition follows. Forms of several
signs stay as they are, so it suits texts without such signs, or rules that drop them.
"""

from __future__ import annotations

import unicodedata

_FORMS = {c: unicodedata.normalize("NFKD", c) for c in map(chr, range(0xA0, 0x30000)) if not 0xD800 <= ord(c) < 0xE000}
_ONE = {c: n for c, n in _FORMS.items() if len(n) == 1 and n != c}
FROM, TO = "".join(_ONE), "".join(_ONE.values())


def nfkc(x: str) -> str:
    """SQL: the compatibility composition of an expression."""
    return f"nfc_normalize(translate({x}, '{FROM}', '{TO.replace(chr(39), chr(39) * 2)}'))"


def norm(x: str) -> str:
    """SQL: TXT1 of an expression. The ellipsis, whose form is three full stops, is dropped as these are."""
    ignored = r"[\s\x{3000}＿_「」『』（）()【】。、．，…・?？!！:：;；\-ー〜～~*＊★☆]+"
    return f"lower(regexp_replace({nfkc(f'coalesce({x}, ' + repr('') + ')')}, '{ignored}', '', 'g'))"

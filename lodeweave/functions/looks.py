"""Characters that look like plain ones, as native column expressions.

The tables are derived from Unicode data by rule; only the look-alike letters are listed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic and Greek letters and the Latin letters of the same look.
LETTERS = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k",
}
# Invisible characters, and spaces other than the plain one.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Full-width signs that are normal Chinese punctuation.
CHINESE_SIGNS = "！（），：；？～"


@cache
def hanzi() -> dict[str, str]:
    """Second code points of Chinese characters (radicals, compatibility ideographs) and the first."""
    out = {}
    for a, z in ((0x2E80, 0x2FE0), (0xF900, 0xFB00), (0x2F800, 0x2FA20)):
        for c in map(chr, range(a, z)):
            n = unicodedata.normalize("NFKC", c)
            if n != c and len(n) == 1:
                out[c] = n
    return out


@cache
def wide() -> dict[str, str]:
    """Full-width letters, digits and signs, without normal Chinese punctuation, and the plain ones."""
    return {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if chr(c) not in CHINESE_SIGNS}


def plain(text: Column, letters: bool = True) -> Column:
    """The text as it looks: full-width forms, odd spaces, second code points of Chinese characters
    and, if letters is set, look-alike letters replaced; invisible characters dropped. NULL stays NULL."""
    table = wide() | {c: " " for c in SPACES} | hanzi() | {"：": ":", "（": "(", "）": ")", "，": ","} | (LETTERS if letters else {})
    bmp = {a: b for a, b in table.items() if ord(a) < 0x10000 and ord(b) < 0x10000}
    return F.translate(text, "".join(bmp) + INVISIBLE, "".join(bmp.values()))

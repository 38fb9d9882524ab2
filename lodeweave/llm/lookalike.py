"""Text that looks the same in different characters (problem 3).

Look-alike classes are the components of a union-find over strings: code points (full-width and
plain forms, second code points of Chinese characters, spaces of other widths, letters of the
same look in three scripts), accented letters as one code point or as letter and accent, and the
empty string with the invisible characters. Links are transitive: full-width A, Latin A, Cyrillic
A and Greek Alpha are one class.

A first scan counts the members in all texts and in words of each script. The representative of a
class is, among its plain members (no full-width form, radical, separate accent or odd space), the one
seen most often, within words in those of that script. A second scan rewrites texts from the left
with Aho-Corasick automata, the longest pattern first: one for all patterns, then one of each
script for the letters of its words.

Words wholly in one script keep their letters, as do single Greek letters; emoji sequences keep
their joiners and selectors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import looks
from lodeweave.session import ship

ACCENTS = "̀-ͯ"
SCRIPTS = ("latin", "greek", "cyrillic")
_LATIN, _OTHER = "A-Za-zÀ-ÖØ-öø-ɏＡ-Ｚａ-ｚ", "Ͱ-ϿЀ-ԯ"
WORD = re.compile(f"[{_LATIN}{_OTHER}][{_LATIN}{_OTHER}{ACCENTS}{looks.INVISIBLE}]*")
ROWS = "sample_id long, field_name string, item_no int, text string, clean string"


class Classes:
    """Union-find over strings with path compression."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def script(c: str) -> str:
    """Script of a letter, or nothing."""
    c = unicodedata.normalize("NFKC", c)[:1]
    if c.isascii():
        return "latin" if c.isalpha() else ""
    name = unicodedata.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), "")


@cache
def classes() -> list[list[str]]:
    """All look-alike classes with more than one member."""
    links = [*looks.wide().items(), *looks.hanzi().items(), *looks.LETTERS.items(), *((c, " ") for c in looks.SPACES), *((c, "") for c in looks.INVISIBLE)]
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        if len(d := unicodedata.normalize("NFD", c)) > 1:
            links.append((d, c))
            if len(d) > 2:
                links.append((unicodedata.normalize("NFC", d[:2]) + d[2:], c))
    found = Classes()
    for a, b in links:
        found.union(a, b)
    return found.groups()


def is_plain(x: str) -> bool:
    return x in ("", " ") or len(x) == 1 and x not in looks.wide() and x not in looks.hanzi() and x not in looks.SPACES and x not in looks.INVISIBLE


@cache
def members() -> frozenset[str]:
    return frozenset(x for g in classes() for x in g)


@cache
def _patterns() -> dict[str, re.Pattern]:
    odd = {x for x in members() if len(x) == 1 and not is_plain(x)}
    return {
        "suspect": re.compile("[" + re.escape("".join(sorted(odd))) + ACCENTS + "".join(looks.LETTERS) + "]"),
        "emoji": re.compile("[←-⯿〰〽㊗㊙‍️\U0001f000-\U0001faff\U000e0020-\U000e007f]*[←-⯿\U0001f000-\U0001faff️][‍️\U0001f3fb-\U0001f3ff←-⯿\U0001f000-\U0001faff]*"),
    }


def word_script(word: str, totals: dict[str, int] | None = None) -> str:
    """Script of a word: that of most letters that no other script looks like; else that of twice as
    many letters as the next; else the commonest in the texts, Latin before others."""
    own, every = Counter(), Counter()
    for c in word:
        if s := script(c):
            every[s] += 1
            own[s] += unicodedata.normalize("NFKC", c)[:1] not in _shared()
    first, second = [*(n for _, n in every.most_common(2)), 0, 0][:2]
    twice = {s for s in every if every[s] == first >= 2 * second}
    return max(every, key=lambda s: (own[s], s in twice, (totals or {}).get(s, 0), s == "latin"), default="")


@cache
def _shared() -> frozenset[str]:
    return frozenset([*looks.LETTERS, *looks.LETTERS.values()])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(script, member, n): every member of one code point in all texts (no script), and the letters
    that several scripts share in words of each script."""
    counts: Counter[tuple[str, str]] = Counter()
    words: Counter[str] = Counter()
    points = np.zeros(0x110000, dtype=np.int64)
    for b in batches:
        text = "\n".join(b.column(0).to_pylist())
        points += np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), minlength=len(points))
        words.update(WORD.findall(text))
    for c in np.flatnonzero(points).tolist():
        if chr(c) in members():
            counts["", chr(c)] = int(points[c])
    for w, n in words.items():
        s = word_script(w)
        for c in w:
            if c in _shared():
                counts[s, c] += n
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["script", "member", "n"])


class Representatives:
    """Representative of each member, outside of words and in words of each script: the commonest plain
    member (of the script). Where a class has one plain member the definition of the problem leaves no choice."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.totals = {s: sum(n for (t, _), n in counts.items() if t == s) for s in SCRIPTS}
        self.plain: dict[str, str] = {}
        self.word: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
        for group in classes():
            plain = sorted(filter(is_plain, group), key=lambda x: (-counts.get(("", x), 0), not x.isascii(), x))
            for x in group:
                same = [p for p in plain if p == "" or script(p) == script(x)] or plain
                if not is_plain(x):
                    self.plain[x] = unicodedata.normalize("NFC", x) if len(x) > 1 else same[0]
                for s in SCRIPTS:
                    if letters := [p for p in plain if script(p) == s]:
                        best = max(letters, key=lambda p: (counts.get((s, p), 0), p.isascii(), p))
                        if best != x and (x in looks.LETTERS or x in looks.LETTERS.values()) and script(x) != s:
                            self.word[s][x] = best


class _Automaton:
    """Greedy rewriting from the left by all patterns at once, the longest first."""

    def __init__(self, patterns: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for a, b in patterns.items():
            self.automaton.add_word(a, (len(a), b))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def rewrite(self, text: str, keep: list[tuple[int, int]] = ()) -> str:
        if self.empty:
            return text
        best: dict[int, tuple[int, str]] = {}
        for end, (n, new) in self.automaton.iter(text):
            a = end + 1 - n
            if n > best.get(a, (0, ""))[0] and not any(x <= a < z for x, z in keep):
                best[a] = (n, new)
        if not best:
            return text
        out, i = [], 0
        for a in sorted(best):
            if a >= i:
                out += (text[i:a], best[a][1])
                i = a + best[a][0]
        return "".join(out) + text[i:]


class Rewriter:
    """Rewriting with one automaton over all patterns that have another representative outside of
    words, then one for the letters within words of each script."""

    def __init__(self, chosen: Representatives):
        self.chosen = chosen
        self.plain = _Automaton(chosen.plain)
        self.words = {s: _Automaton(letters) for s, letters in chosen.word.items()}

    def rewrite(self, text: str) -> str:
        if not _patterns()["suspect"].search(text):
            return text
        keep = []
        if "‍" in text:
            for m in _patterns()["emoji"].finditer(text):
                inner = m.group()
                keep.append((m.start() + len(inner) - len(inner.lstrip("‍")), m.start() + len(inner.rstrip("‍"))))
        return WORD.sub(self._word, self.plain.rewrite(text, keep))

    def _word(self, m: re.Match) -> str:
        word = m.group()
        if word.isascii() or not any(c in looks.LETTERS for c in word) and all(script(c) == "latin" for c in word):
            return word
        s = word_script(word, self.chosen.totals)
        return self.words[s].rewrite(word) if s else word


def representatives(texts: DataFrame) -> Representatives:
    """Representatives from the counts over all texts; the driver gets at most scripts times members rows."""
    rows = texts.select("text").filter("text is not null").mapInArrow(counted, "script string, member string, n long")
    return Representatives({(r[0], r[1]): r[2] for r in rows.groupBy("script", "member").agg(F.sum("n")).collect()})


def rewritten(texts: DataFrame) -> DataFrame:
    """Rows whose text is not in its consistent form, with that form as ``clean``.

    ``texts``: sample_id, field_name, item_no, text; other columns are ignored. NULL and empty
    texts give no rows, nor does an empty table; repeated rows count on their own.
    """
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(representatives(texts))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = Rewriter(shared.value)
        for b in batches:
            rows = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (clean := rewriter.rewrite(row[3])) != row[3]:
                    rows.append((*row, clean))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["sample_id", "field_name", "item_no", "text", "clean"])

    return texts.filter("text is not null").select("sample_id", "field_name", "item_no", "text").mapInArrow(part, ROWS)

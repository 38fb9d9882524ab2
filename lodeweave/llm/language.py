"""Languages of documents and of their parts by prediction by partial matching (problem 9).

Each language has a variable-order byte context tree (orders 0 to ORDER, escape method C, no
exclusion) with frozen counts. The code length of a byte is that of the longest context in which
the tree knows it, plus the escapes from longer contexts that it knows without that byte; below
order 0 all bytes are alike. A sentence gets the language with the shortest code.

All trees are laid out in two hash tables with one row of code lengths, one column a language:
(context, byte) and (context, escape). Code lengths of whole batches come from a few array
lookups per byte. The trees are fitted on a sample of labelled documents of at most SAMPLE rows
in expectation, none longer than SAMPLE_CHARS; labels may be wrong, so that sentences of the
sample are classified and the trees fitted again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.session import ship, spread

CODES = ("zh", "en", "ja", "ko", "ru", "es", "pt")
#: Longest context in bytes; labelled documents in the sample and their longest text; refits.
ORDER, SAMPLE, SAMPLE_CHARS, REFITS = 4, 3000, 6000, 2
#: Bytes scored at once.
CHUNK = 1 << 20
#: Least letter bytes of a sentence, bits by which its code must be shorter than that of another language of the document.
LEAST_LETTERS, LEAST_BITS = 12, 12.0
# Usual spellings of the languages besides the code.
SPELLINGS = {
    "zh": "zho chi cmn chinese mandarin", "en": "eng english", "ja": "jpn jp japanese", "ko": "kor kr korean",
    "ru": "rus russian", "es": "spa esp spanish castilian", "pt": "por portuguese",
}


def named(lang: Column) -> Column:
    """Code of the language that a label names, else NULL."""
    word = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)", 1))
    table = {s: c for c, names in SPELLINGS.items() for s in [c, *names.split()]}
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word)
    names = {s: c for s, c in table.items() if len(s) > 3}
    inside = F.coalesce(*[F.when(F.lower(lang).contains(s), F.lit(c)) for s, c in names.items()])
    return F.coalesce(found, inside)


def sentence_ends(data: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Ends of the sentences in the UTF-8 bytes of documents one after another."""
    n = len(data)
    after = np.append(data[1:], 10)
    stop = (data == 10) | (((data == 46) | (data == 33) | (data == 63)) & ((after == 32) | (after == 10)))
    if n > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        full = ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
        stop[2:] |= full
    return np.unique(np.concatenate([np.flatnonzero(stop) + 1, doc_ends[doc_ends > 0]]))


class Table:
    """Open-addressing hash table from 64-bit keys to rows."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.rows[at] < 0
            cand, where = left[free], at[free]
            _, first = np.unique(where, return_index=True)
            self.keys[where[first]], self.rows[where[first]] = keys[cand[first]], cand[first]
            done = np.zeros(len(keys), dtype=bool)
            done[cand[first]] = True
            keep = ~done[left]
            left, at = left[keep], (at[keep] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not known."""
        at = self.slots(keys)
        row, same = self.rows[at], self.keys[at] == keys
        out = np.where(same, row, -1)
        open_ = np.flatnonzero(~same & (row >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            row, same = self.rows[at[open_]], self.keys[at[open_]] == keys[open_]
            out[open_[same]] = row[same]
            open_ = open_[~same & (row >= 0)]
        return out


def _windows(data: np.ndarray) -> np.ndarray:
    """Each byte and its ORDER predecessors in one word, the byte lowest."""
    word = data.astype(np.uint64)
    for j in range(1, ORDER + 1):
        word[j:] |= data[:-j].astype(np.uint64) << np.uint64(8 * j)
    return word


def _key(words: np.ndarray, k: int) -> np.ndarray:
    return (words & np.uint64((1 << 8 * (k + 1)) - 1)) | np.uint64((k + 1) << 56)


def _context(words: np.ndarray, k: int) -> np.ndarray:
    return ((words >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)) | np.uint64((k + 1) << 56 | 1 << 63)


class Trees:
    """Context trees of all languages with frozen statistics."""

    def __init__(self, sentences: dict[str, list[bytes]]):
        parts = {}
        for lang in CODES:
            data = np.frombuffer(b"".join(sentences.get(lang, [])), dtype=np.uint8)
            lens = np.array([len(s) for s in sentences.get(lang, [])], dtype=np.int64)
            parts[lang] = (_windows(data), np.arange(len(data)) - np.repeat(np.cumsum(lens) - lens, lens)) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, costs, contexts, escapes, lower = [], [], [], [], None
        for k in range(ORDER + 1):
            seen = {lang: np.unique(_key(w[pos >= k], k), return_counts=True) for lang, (w, pos) in parts.items()}
            union = np.unique(np.concatenate([s for s, _ in seen.values()]))
            known = np.unique(_context(union, k))
            cost, escape = np.empty((len(union), len(CODES)), np.float32), np.zeros((len(known), len(CODES)), np.float32)
            below = np.full((len(union), len(CODES)), 8.0, np.float32) if k == 0 else lower[1][np.searchsorted(lower[0], _key(union, k - 1))]
            for j, lang in enumerate(CODES):
                s, c = seen[lang]
                cost[:, j] = below[:, j]
                if not len(s):
                    continue
                ctx, inverse = np.unique(_context(s, k), return_inverse=True)
                total, kinds = np.bincount(inverse, c), np.bincount(inverse)
                esc = -np.log2(kinds / (total + kinds))
                escape[np.searchsorted(known, ctx), j] = esc
                of = np.searchsorted(ctx, _context(union, k))
                has = (of < len(ctx)) & (ctx[np.minimum(of, len(ctx) - 1)] == _context(union, k))
                cost[has, j] += esc[of[has]]
                cost[np.searchsorted(union, s), j] = -np.log2(c / (total + kinds)[inverse])
            keys.append(union)
            costs.append(cost)
            contexts.append(known)
            escapes.append(escape)
            lower = (union, cost)
        self.symbols, self.costs = Table(np.concatenate(keys)), np.concatenate(costs)
        self.contexts, self.escapes = Table(np.concatenate(contexts)), np.concatenate(escapes)

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each sentence in bits under each language; long inputs go through in whole sentences."""
        if len(data) > 2 * CHUNK and len(starts) > 1:
            half = int(np.clip(np.searchsorted(starts, len(data) // 2), 1, len(starts) - 1))
            at = int(starts[half])
            return np.vstack([self.lengths(data[:at], starts[:half]), self.lengths(data[at:], starts[half:] - at)])
        words, n = _windows(data), len(data)
        begin = np.zeros(n, dtype=np.int64)
        begin[starts] = starts
        allowed = np.minimum(np.arange(n) - np.maximum.accumulate(begin), ORDER)
        total = np.zeros((n, len(CODES)), dtype=np.float32)
        left = np.arange(n)
        for k in range(ORDER, -1, -1):
            long = allowed[left] >= k
            now, later = left[long], left[~long]
            w = words[now]
            row = self.symbols.find(_key(w, k))
            hit = row >= 0
            total[now[hit]] += self.costs[row[hit]]
            missed = now[~hit]
            row = self.contexts.find(_context(w[~hit], k))
            inside = row >= 0
            total[missed[inside]] += self.escapes[row[inside]]
            left = np.concatenate([missed, later])
        total[left] += np.float32(8.0)
        return np.add.reduceat(total, starts, axis=0)


def _letters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter bytes and words (runs of letter bytes) of each sentence."""
    low = data | 32
    letter = (data >= 0xC2) | ((data >= 0x80) & (data < 0xC0)) | ((low >= 97) & (low <= 122))
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    first[starts] = letter[starts]
    return np.add.reduceat(letter.astype(np.int64), starts), np.add.reduceat(first.astype(np.int64), starts)


def fit(rows: list[tuple[str, str]]) -> Trees:
    """Trees from labelled texts (code, text).

    The sentences of every second text are classified by the trees of the other texts, so that a
    wrong label cannot confirm itself; then all trees are fitted on the sentences as classified.
    """
    halves: list[dict[str, list[bytes]]] = [{c: [] for c in CODES} for _ in range(2)]
    for i, (code, text) in enumerate(sorted(rows, key=lambda r: r[1])):
        halves[i % 2][code] += [s.encode() for s in re.split(r"(?<=[。！？\n])|(?<=[.!?]) ", text) if len(s) > 3 and re.search(r"[^\W\d_]", s)]
    for _ in range(REFITS):
        trees = [Trees(h) for h in halves]
        for k in range(2):
            every = [s for c in CODES for s in halves[k][c]]
            if every and any(halves[1 - k].values()):
                lens = np.array([len(s) for s in every])
                best = trees[1 - k].lengths(np.frombuffer(b"".join(every), np.uint8), np.cumsum(lens) - lens).argmin(axis=1)
                halves[k] = {c: [s for s, b in zip(every, best) if b == j] for j, c in enumerate(CODES)}
    return Trees({c: halves[0][c] + halves[1][c] for c in CODES})


def sample(documents: DataFrame) -> list[tuple[str, str]]:
    """Labelled documents for the fit: about SAMPLE rows by a hash of the id, whatever the corpus' size."""
    known = documents.select("doc_id", named(F.col("lang")).alias("code"), "text").filter(f"code is not null and text <> '' and length(text) <= {SAMPLE_CHARS}")
    count = documents.count()
    every = max(1, count // SAMPLE)
    return [(r[0], r[1]) for r in known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("code", "text").collect()]


SENTENCES = "doc_id long, named string, first int, last int, code string, confidence double, bits double"


def parts(documents: DataFrame) -> DataFrame:
    """Parts of documents in one language: sentences in a row with the same language, merged.

    ``documents``: doc_id, text, lang; further columns are ignored. NULL and empty texts and texts
    without a sentence have no part; an empty table gives no rows; repeated texts count each.
    Result: doc_id, named (code that lang names), first, last (byte offsets), code, confidence
    (least of the sentences'), bits (code length). A sentence counts with LEAST_LETTERS letter bytes and three
    words (or four bytes of a script without spaces), and as in another language than the document's main one
    only if its code is shorter by LEAST_BITS there.
    """
    ship(documents.sparkSession)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fit(sample(documents)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            blob = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            i = 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                out = _scored(trees, blob[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if out is not None:
                    doc, *rest = out
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), batch.column(2).slice(i, j - i).take(pa.array(doc)), *map(pa.array, rest)], names=["doc_id", "named", "first", "last", "code", "confidence", "bits"])
                i = j

    return spread(documents.filter("text <> ''").select("doc_id", "text", named(F.col("lang")).alias("named"))).mapInArrow(score, SENTENCES)


def _scored(trees: Trees, data: np.ndarray, bounds: np.ndarray):
    """Parts of the documents that lie between the bounds: document, first, last, code, confidence, bits."""
    if not len(data):
        return None
    ends = sentence_ends(data, bounds[1:])
    starts = np.concatenate([[0], ends[:-1]])
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    bits = trees.lengths(data, starts)
    letters, words = _letters(data, starts)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    cjk = np.add.reduceat((data >= 0xE3).astype(np.int64), starts)
    whole = (letters >= LEAST_LETTERS) & ((words >= 3) | (cjk >= 4))
    if not whole.any():
        return None
    starts, ends, bits, doc = starts[whole], ends[whole], bits[whole], doc[whole]
    best = bits.argmin(axis=1)
    low = bits.min(axis=1)
    confidence = 1 / np.exp2(np.minimum(low[:, None] - bits, 0)).sum(axis=1)
    # main language of each document: shortest code of all its whole sentences
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    main = np.repeat(np.add.reduceat(bits, cut, axis=0).argmin(axis=1), np.diff(np.append(cut, len(doc))))
    gain = bits[np.arange(len(doc)), main] - low
    best = np.where(gain < LEAST_BITS, main, best)
    run = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]))
    last = np.append(run[1:], len(doc)) - 1
    own = bits[np.arange(len(doc)), best]
    base = bounds[doc]
    codes = np.array(CODES)
    return doc[run], (starts - base)[run].astype(np.int32), (ends - base)[last].astype(np.int32), codes[best[run]], np.minimum.reduceat(confidence, run).astype(float), np.add.reduceat(own, run).astype(float)


def unnamed(found: DataFrame) -> DataFrame:
    """doc_id and code of each language of a part that the document's label does not name."""
    return found.filter("named is null or named <> code").select("doc_id", F.col("code").alias("lang_code")).distinct()


def main_language(found: DataFrame) -> DataFrame:
    """One row per document: the language of most bytes, its share of the bytes and the least confidence of its parts."""
    by = found.groupBy("doc_id", "named", "code").agg(F.sum(F.col("last") - F.col("first")).alias("bytes"), F.min("confidence").alias("confidence"))
    all_ = by.groupBy("doc_id", "named").agg(F.sum("bytes").alias("total"), F.max(F.struct("bytes", F.col("code").alias("code"), "confidence")).alias("m"))
    return all_.select("doc_id", "named", F.col("m.code").alias("lang_code"), (F.col("m.bytes") / F.col("total")).alias("share"), F.col("m.confidence").alias("confidence"))

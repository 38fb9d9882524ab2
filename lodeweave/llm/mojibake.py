"""Text decoded with the wrong character set: detection and repair (problem 2).

Model. A stretch of a text either is as it was written or went through one of several *chains*
(bytes of one charset read as another, once or twice). Which chain is latent. One scan over the
texts finds, per chain, the stretches whose characters can be turned back into bytes that decode
under the true charset, and counts all characters. Expectation-maximization then alternates

* E: posterior of each stretch from the log-likelihood ratio of its two readings under a
  character model of clean text, and from the chain's rate in the pool (source, field);
* M: the rates of each pool (texts with the chain), shrunk towards the chain's overall rate, and
  the character model: counted characters less those of the stretches, weighted by their posterior.
  Decoded characters are not added: a reading must not become its own evidence.

What the driver gathers is bounded by the number of code points and of pools times chains.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut, ship

LOST = "lost"
#: Log-likelihood ratio of a stretch whose characters no clean text has (replacement marks, private use, C1 controls).
CERTAIN = 30.0
#: Weight, in items, of a chain's overall rate within each pool.
SHRINK = 200.0
#: EM ends when the chains' rates change by less than this part of their sum, or after so many rounds.
SETTLED, MOST_ROUNDS = 0.01, 50
#: Count of a decoded character that clean text lacks: of a sign or one of the 3755 commonest Chinese characters, of any other letter.
UNSEEN, STRANGE = 0.5, 1e-4
SCHEMA = "kind string, key string, n double, sample_id long, field_name string, item_no int, ref string, source string, chain string, pos int, obs string, dec string, text string"
ARROW = pa.schema([("kind", pa.string()), ("key", pa.string()), ("n", pa.float64()), ("sample_id", pa.int64()), ("field_name", pa.string()), ("item_no", pa.int32()), ("ref", pa.string()), ("source", pa.string()), ("chain", pa.string()), ("pos", pa.int32()), ("obs", pa.string()), ("dec", pa.string()), ("text", pa.string())])


def _high(charset: str) -> dict[str, int]:
    """Characters that the bytes 128 to 255 show under a single-byte charset; bytes without one show as C1 controls."""
    return {chr(b): b for b in range(0x80, 0x100)} | {bytes([b]).decode(charset): b for b in range(0x80, 0x100) if bytes([b]).decode(charset, "ignore")} if charset == "cp1252" else {(bytes([b]).decode(charset, "ignore") or chr(b)): b for b in range(0x80, 0x100)}


@cache
def _tables() -> dict:
    """Tables derived from the codecs, once per worker."""
    singles = {name: _high(name) for name in ("cp1252", "mac_roman", "cp1251")}
    common = {bytes([a, b]).decode("gb2312", "ignore") for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)} - {""}
    punct = set("，。！？、：；“”（）")
    lead, pair, tail, big5, strong = [], [], [], {}, set()
    for a in range(0x81, 0xFF):
        for b in range(0x40, 0xFF):
            raw = bytes([a, b])
            if c := raw.decode("gb18030", "ignore"):
                if len(c) == 1:
                    if (0xE2 <= a <= 0xEF or a == 0xF0 and b >= 0x90) and 0x80 <= b <= 0xBF:
                        lead.append(c)
                    if 0x80 <= a <= 0xBF and (0xE2 <= b <= 0xEF or b == 0xF0):
                        pair.append(c)
                    if 0x80 <= a <= 0xBF and 0x80 <= b <= 0xBF:
                        tail.append(c)
            c, d = raw.decode("big5", "ignore"), raw.decode("gbk", "ignore")
            if len(c) == 1 and len(d) == 1 and c.encode("big5") == raw:
                big5[c] = d
                if (d in common or d in punct) and c not in common and ("㐀" <= c <= "鿿" or "ㄅ" <= c <= "ㄩ"):
                    strong.add(c)
    cls = lambda xs: "[" + "".join(map(re.escape, sorted(xs))) + "]"
    x1, x2, x3 = cls(lead), cls(pair), cls(tail)
    lost = "\ufffd\ue000-\uf8ff\x80-\x9f"
    return {
        "singles": {k: (re.compile(cls(v) + "{2,}"), str.maketrans({c: chr(b) for c, b in v.items()})) for k, v in singles.items()},
        "gbk_shown": re.compile(f"(?:{x3}|{x2}{x3}?)?(?:{x1}(?:{x2}|\ufffd)(?:{x3}|\ufffd)?|{x1}{x3}|{x1}\ufffd?)+"),
        "gbk_anchor": re.compile(f"{x1}(?:{x2}|{x3}|[\ufffd\ue000-\uf8ff])"),
        "usual": frozenset(common),
        "big5": big5,
        "big5_run": re.compile("(?:" + cls(set(big5) | {"\ufffd"}) + "|[0-9A-Za-z])+"),
        "big5_strong": re.compile(cls(strong)),
        "zhuyin": re.compile("[ㄅ-ㄩ]"),
        "lost": re.compile(f"[{lost}]+"),
        "high": re.compile("[" + lost + "".join(map(re.escape, sorted(set().union(*(set(v) for v in singles.values())) - set("éëíöüçÉαβ’‘“”…—·°")))) + "éëíöüçÉ·°‘’“”…—" + "]"),
    }


UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2})+")
GBK = re.compile(rb"(?:[\xa1-\xa9\xb0-\xf7][\xa1-\xfe])+")


def _decoded_once(text: str, name: str, t: dict) -> str:
    """The text with every UTF-8 sequence that a single-byte charset shows decoded."""
    pattern, table = t["singles"][name]

    def run(m: re.Match) -> str:
        raw = m.group().translate(table).encode("latin-1")
        out, last = [], 0
        for k in UTF8.finditer(raw):
            out += [m.group()[last : k.start()], k.group().decode("utf-8", "ignore")]
            last = k.end()
        return "".join(out) + m.group()[last:]

    return pattern.sub(run, text)


def _single(text: str, name: str, t: dict) -> Iterator[tuple[str, int, str, str]]:
    """Stretches that were UTF-8 (once, twice) or GBK bytes shown by a single-byte charset."""
    pattern, table = t["singles"][name]
    for run in pattern.finditer(text):
        shown, start = run.group(), run.start()
        raw = shown.translate(table).encode("latin-1")
        for m in UTF8.finditer(raw):
            once = m.group().decode("utf-8", "ignore")
            yield f"utf8>{name}", start + m.start(), shown[m.start() : m.end()], once
            if pattern.search(once) and (twice := _decoded_once(once, name, t)) != once:
                yield f"utf8>{name}>{name}", start + m.start(), shown[m.start() : m.end()], twice
        if name == "cp1252":
            for m in GBK.finditer(raw):
                yield "gbk>cp1252", start + m.start(), shown[m.start() : m.end()], m.group().decode("gbk", "ignore")


def stretches(text: str) -> list[tuple[str, int, str, str]]:
    """(chain, position, observed, decoded) of each stretch that some chain explains."""
    t, out = _tables(), []
    if t["high"].search(text):
        for name in t["singles"]:
            out += _single(text, name, t)
        out += [(LOST, m.start(), m.group(), "") for m in t["lost"].finditer(text)]
    if t["gbk_anchor"].search(text):
        for m in t["gbk_shown"].finditer(text):
            run = m.group()
            raw = run.encode("gb18030", "ignore")
            if "\ufffd" in run:
                found = b"".join(UTF8.findall(raw))
                if len(found) >= 0.6 * len(raw):
                    out.append(("utf8>gbk", m.start(), run, found.decode("utf-8", "ignore")))
            elif len(raw) == 2 * len(run):
                for k in UTF8.finditer(raw):
                    if k.start() % 2 == k.end() % 2 == 0:  # whole characters on both sides
                        out.append(("utf8>gbk", m.start() + k.start() // 2, run[k.start() // 2 : k.end() // 2], k.group().decode("utf-8", "ignore")))
    hits = len(t["big5_strong"].findall(text))
    if hits:
        for m in t["big5_run"].finditer(text):
            run = m.group()
            marks = [k.start() for k in t["big5_strong"].finditer(run)]
            while marks:  # groups of strong characters with at most two others between
                k = 1
                while k < len(marks) and marks[k] - marks[k - 1] <= 3:
                    k += 1
                group, marks = marks[:k], marks[k:]
                a, z = group[0], group[-1] + 1
                if len(group) == 1 and not t["zhuyin"].match(run[a]):  # with its neighbours that turn into usual characters
                    usual = lambda c: c.isascii() or t["big5"].get(c) in t["usual"]
                    while a > max(0, group[0] - 6) and usual(run[a - 1]):
                        a -= 1
                    while z < min(len(run), group[0] + 7) and usual(run[z]):
                        z += 1
                part = run[a:z]
                if z - a >= 3 or len(group) >= 2 or t["zhuyin"].match(part):
                    out.append(("gbk>big5", m.start() + a, part, "".join(t["big5"].get(c, c if c.isascii() else "") for c in part)))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chars: Counter[str] = Counter()
    pools: Counter[str] = Counter()
    seen: dict[str, list] = {}
    for batch in batches:
        ids, fields, items, refs, sources, texts = (batch.column(i).to_pylist() for i in range(6))
        rows: list[tuple] = []
        chars.update("".join(texts))
        pools.update(f"{s}\t{f}" for s, f in zip(sources, fields))
        for i, text in enumerate(texts):
            if (got := seen.get(text)) is None:
                got = stretches(text)
                if len(text) < 16 and len(seen) < 50_000:
                    seen[text] = got
            rows += [("s", "", 0.0, ids[i], fields[i], items[i], refs[i], sources[i], *x, text) for x in got]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)
    rows = [("n", c, float(n)) for c, n in chars.items()] + [("t", c, float(n)) for c, n in pools.items()]
    if rows:
        kinds, keys, counts = zip(*rows)
        rest = [pa.nulls(len(rows), f.type) for f in list(ARROW)[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array(counts), *rest], schema=ARROW)


class Model:
    """Character counts of clean text and the rates of the chains by pool."""

    def __init__(self, counts: dict[str, float], rates: dict[tuple[str, str, str], float], overall: dict[str, float]):
        self.counts, self.rates, self.overall = counts, rates, overall
        self.total = math.log(max(2.0, sum(counts.values())))

    def ratio(self, chain: str, obs: str, dec: str) -> float:
        """Log-likelihood ratio of the decoded against the observed reading."""
        if chain == LOST:
            return CERTAIN
        log = lambda c, least=0.05: math.log(max(self.counts.get(c, 0.0), least)) - self.total
        sure = CERTAIN * ("\ufffd" in dec or any(c == "\ufffd" or "\ue000" <= c <= "\uf8ff" or "\x80" <= c <= "\x9f" for c in obs))
        # a reading with strange letters that no clean text has is weak evidence
        usual = _tables()["usual"]
        return sum(log(c, UNSEEN if c in usual or not c.isalpha() else STRANGE) for c in dec) - sum(map(log, obs)) + sure

    def log_odds(self, source: str, field: str, chain: str, obs: str, dec: str) -> float:
        """Posterior log-odds that the stretch is garbled."""
        rate = min(0.5, max(1e-6, self.rates.get((source, field, chain), self.overall.get(chain, 1e-3))))
        x = self.ratio(chain, obs, dec) + math.log(rate / (1 - rate))
        return max(-500.0, min(500.0, x))


def garbled(texts: DataFrame) -> DataFrame:
    """Every candidate stretch with the posterior that it is garbled.

    ``texts``: sample_id, field_name, item_no, ref, source, text. NULL texts are skipped and the
    empty text has no stretch; a NULL source is a pool of its own; an empty table gives no rows.
    Result: those columns and chain, pos, obs, dec, posterior.
    """
    ship(texts.sparkSession)
    spark = texts.sparkSession
    columns = ["sample_id", "field_name", "item_no", "ref", "source", "text"]
    scanned = cut(texts.withColumn("source", F.coalesce("source", F.lit(""))).filter("text is not null").select(*columns).mapInArrow(_scan, SCHEMA))
    counted = {(r[0], r[1]): r[2] for r in scanned.filter("kind <> 's'").groupBy("kind", "key").agg(F.sum("n")).collect()}
    found = scanned.filter("kind = 's'").drop("kind", "key", "n")
    chars = {k: n for (kind, k), n in counted.items() if kind == "n"}
    pools = {tuple(k.split("\t")): n for (kind, k), n in counted.items() if kind == "t"}
    model = Model(chars, {}, {})
    for _ in range(MOST_ROUNDS):
        before, model = model.overall, _maximize(chars, pools, _expect(spark, found, model))
        moved = sum(abs(model.overall.get(c, 0.0) - before.get(c, 0.0)) for c in {*before, *model.overall})
        if moved <= SETTLED * sum(model.overall.values()):
            break
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            get = lambda k: b.column(b.schema.get_field_index(k)).to_pylist()
            odds = [m.log_odds(*x) for x in zip(get("source"), get("field_name"), get("chain"), get("obs"), get("dec"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(odds, pa.float64()), pa.array([1 / (1 + math.exp(-x)) for x in odds], pa.float64())], names=[*b.schema.names, "log_odds", "posterior"])

    return found.mapInArrow(judge, SCHEMA.split("n double, ")[1] + ", log_odds double, posterior double")


def _expect(spark, found: DataFrame, model: Model) -> dict[tuple[str, str], float]:
    """Expected counts under the model: characters gained and lost, stretches by pool and chain."""
    shared = spark.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = shared.value, Counter()
        for b in batches:
            for (_, _, _), rows in groupby(zip(*(b.column(i).to_pylist() for i in range(8))), key=lambda r: r[:3]):
                _add(m, sums, list(rows))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()), pa.float64())], names=["kind", "key", "n"])

    rows = found.select("sample_id", "field_name", "item_no", "source", "chain", "pos", "obs", "dec").mapInArrow(part, "kind string, key string, n double")
    return {(r[0], r[1]): r[2] for r in rows.groupBy("kind", "key").agg(F.sum("n")).collect()}


def _add(model: Model, sums: Counter, rows: list[tuple]) -> None:
    """Adds the stretches of one text, best first: a character is lost once, whatever chains explain it."""
    scored = sorted(((model.log_odds(r[3], r[1], r[4], r[6], r[7]), r) for r in rows), key=lambda x: (-x[0], x[1][5], x[1][4]))
    taken: set[int] = set()
    pools: dict[str, float] = {}
    for x, (_, field, _, source, chain, pos, obs, _) in scored:
        here = {pos + i for i in range(len(obs))}
        if here & taken:
            continue
        taken |= here
        p = 1 / (1 + math.exp(-x))
        key = f"{source}\t{field}\t{chain}"
        pools[key] = max(p, pools.get(key, 0.0))
        for c in obs:
            sums["n", c] -= p
    for key, p in pools.items():
        sums["r", key] += p


def _maximize(chars: dict, pools: dict, sums: dict) -> Model:
    counts = dict(chars)
    by_chain: Counter[str] = Counter()
    for (kind, key), n in sums.items():
        if kind == "n":
            counts[key] = max(0.0, counts.get(key, 0.0) + n)
        else:
            by_chain[key.split("\t")[2]] += n
    items = sum(pools.values()) or 1.0
    overall = {c: (n + 0.5) / (items + 1) for c, n in by_chain.items()}
    rates = {}
    for (kind, key), n in sums.items():
        if kind == "r":
            source, field, chain = key.split("\t")
            rates[source, field, chain] = (n + SHRINK * overall[chain]) / (pools.get((source, field), 0.0) + SHRINK)
    return Model(counts, rates, overall)


def repaired(judged: DataFrame) -> DataFrame:
    """One row per garbled text: the text with its stretches replaced, and whether all of it came back.

    Of stretches that overlap the one of the highest posterior odds (then the longest) is used. A
    stretch whose bytes were lost stays as it is and makes the text unrecoverable.
    """

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fields, items, texts, marks = (b.column(i).to_pylist() for i in range(5))
            rows = []
            for i, text in enumerate(texts):
                done, whole, best = [], True, 0.0
                for m in sorted(marks[i], key=lambda m: (m["chain"] == LOST, -m["log_odds"], -len(m["obs"]), m["pos"])):
                    a, z = m["pos"], m["pos"] + len(m["obs"])
                    if all(z <= x or a >= y for x, y, _ in done):
                        lost = m["chain"] == LOST or "\ufffd" in m["obs"]
                        whole &= not lost
                        done.append((a, z, m["obs"] if m["chain"] == LOST else m["dec"]))
                        best = max(best, m["posterior"])
                out, last = [], 0
                for a, z, new in sorted(done):
                    out += [text[last:a], new]
                    last = z
                rows.append((ids[i], fields[i], items[i], "".join(out) + text[last:], whole, best))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.float64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["sample_id", "field_name", "item_no", "repaired_text", "recoverable", "posterior"])

    marks = judged.filter("posterior >= 0.5").groupBy("sample_id", "field_name", "item_no").agg(F.first("text").alias("text"), F.collect_list(F.struct("chain", "pos", "obs", "dec", "posterior", "log_odds")).alias("marks"))
    return marks.mapInArrow(mend, "sample_id long, field_name string, item_no int, repaired_text string, recoverable boolean, posterior double")

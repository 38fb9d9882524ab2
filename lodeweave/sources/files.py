"""Subtitle files, and review sheets exported as HTML tables or spreadsheets; all read by Spark's binary file source."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a review sheet, and polarity by sentiment.
COLUMNS = ("评论内容", "评论时间", "评论情感", "来自商品", "来源小店", "商品链接")
POLARITY = {"好评": "pos", "中评": "neu", "差评": "neg"}
_TIMES = re.compile(r"(\d\d:\d\d:\d\d[,.]\d{3})\s*-->\s*(\d\d:\d\d:\d\d[,.]\d{3})")


def decoded(raw: bytes) -> str:
    """UTF-8, else GB18030 with undecodable bytes left out."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("gb18030", "ignore")


def subtitle_cues(text: str) -> list[tuple[str, str, str]]:
    """Start, end and text of the cues: blocks between blank lines, the time line anywhere in them."""
    out = []
    for block in re.split(r"\r?\n\s*\r?\n", text.strip()):
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        at = next((i for i, x in enumerate(lines) if _TIMES.search(x)), None)
        if at is not None and (said := " ".join(lines[at + 1 :])):
            out.append((*_TIMES.search(lines[at]).groups(), said))
    return out


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Path, idx, start_ts, end_ts, text of all cues of the files of a glob; idx counts kept cues."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, *cue) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, cue in enumerate(subtitle_cues(decoded(c)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["path", "idx", "start_ts", "end_ts", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, idx int, start_ts string, end_ts string, text string")


class _Table(HTMLParser):
    """Cells of the first table of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth = self.tables = 0
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.depth += 1
        elif self.tables == 1 and self.depth:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.rows[-1].append("")
                self.open = True

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data


def sheet_rows(raw: bytes) -> list[dict[str, str]]:
    """Rows of a sheet by column name: a spreadsheet by its first bytes, else an HTML table.

    An empty file has no rows. A spreadsheet that can't be read, or a file without any table, is an error.
    """
    if not raw.strip():
        return []
    if raw[:4] in (b"PK\x03\x04", b"\xd0\xcf\x11\xe0"):
        import pandas as pd

        frame = pd.read_excel(io.BytesIO(raw), dtype=str).fillna("")
        return [{str(k).strip(): v for k, v in r.items()} for r in frame.to_dict("records")]
    table = _Table()
    table.feed(decoded(raw))
    if not table.tables:
        raise ValueError("neither a spreadsheet nor an HTML table")
    head = [c.strip() for c in table.rows[0]] if table.rows else []
    return [dict(zip(head, r)) for r in table.rows[1:]]


SHEET = "comment_id string, text string, time string, sentiment string, polarity string, shop string, error string"


def read_review_sheets(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Reviews of the exported sheets of a glob, on whatever file system it names.

    comment_id is the file's stem and the row's number, counted before rows without a text are
    dropped; an unknown sentiment is neutral. A sheet that can't be read raises, or is a row with
    the error if not strict.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for place, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stem = place.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    sheet = sheet_rows(raw)
                except Exception as x:  # noqa: BLE001  whatever the reader of spreadsheets raises
                    if strict:
                        raise ValueError(f"{place}: {x}") from x
                    rows.append((stem, None, None, None, None, None, f"{type(x).__name__}: {x}"))
                    continue
                for i, row in enumerate(sheet):
                    text, mood = row.get(COLUMNS[0], "").strip(), row.get(COLUMNS[2], "").strip()
                    if text:
                        rows.append((f"{stem}#{i}", text, row.get(COLUMNS[1], "").strip(), mood, POLARITY.get(mood, "neu"), row.get(COLUMNS[4], "").strip(), None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=[c.split()[0] for c in SHEET.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, SHEET)


def write_review_sheets(reviews: DataFrame, path: str) -> None:
    """The counterpart of ``read_review_sheets``: text, time, sentiment and shop as HTML tables, one file for each partition."""

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from html import escape

        cells = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{escape(x or '')}</{tag}>" for x in xs) + "</tr>"
        yield pa.RecordBatch.from_arrays([pa.array(["<table>" + cells("th", COLUMNS)])], names=["value"])
        for b in batches:
            lines = [cells("td", (text, when, mood, "", shop, "")).replace("\n", " ") for text, when, mood, shop in zip(*(b.column(i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</table>"])], names=["value"])

    reviews.select("text", "time", "sentiment", "shop").mapInArrow(page, "value string").write.mode("overwrite").text(path)


def review_polarity(sentiment):
    """Polarity of a sentiment column, neutral by default."""
    table = F.create_map(*[F.lit(x) for kv in POLARITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(sentiment)), F.lit("neu"))

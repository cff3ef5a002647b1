"""Blocks, overlapping chunks, section headings and chunk ids.

Places where a text may break are listed once, in one pass over it, and every
border is a binary search in such a list, so the work grows with the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_path, strip

HEADING_CHARS = 2000
#: What a chunk may end with, the best first. Fixed values.
BREAKS = ("\n\n", ". ", "\n")
#: Characters of text that a task cuts before it gives the rows out.
_LOT = 1 << 20


class _Breaks:
    """The places of a string in a text, overlapping ones too."""

    def __init__(self, text: str, what: str) -> None:
        self.places, self.width = [m.start() for m in re.finditer(f"(?={re.escape(what)})", text)], len(what)

    def last_end(self, low: int, high: int) -> int | None:
        """End of the last one that lies between ``low`` and ``high``."""
        k = bisect_right(self.places, high - self.width) - 1
        return self.places[k] + self.width if k >= 0 and self.places[k] >= low else None


def cut_blocks(text: str, size: int, back: int) -> Iterator[tuple[int, int]]:
    """Borders of blocks of ``size`` characters, or to the last line end beyond ``back``."""
    lines, at = _Breaks(text, "\n") if len(text) > size else None, 0
    while at < len(text):
        whole = at + size >= len(text)
        end = len(text) if whole else lines.last_end(at + back + 1, at + size) or at + size
        yield at, end
        at = end


def cut_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Borders of overlapping chunks; see ``spans``."""
    kinds, at, end = [_Breaks(text, w) for w in BREAKS] if len(text) > size else [], 0, 0
    while end < len(text):
        found = (kind.last_end(at + size // 2, at + size) for kind in kinds)
        end = len(text) if at + size >= len(text) else next((e for e in found if e), at + size)
        yield at, end
        at = max(end - overlap, at + 1)


def _borders(cut, *sizes: int):
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in cut(t, *sizes)])
    return run


def blocks(text: Column, size: int = 200_000, back: int = 10_000) -> Column:
    """Array of (start, end) that partitions a text: ``size`` characters, or to the last line end beyond ``back``."""
    return _borders(cut_blocks, size, back)(text)


def spans(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Array of (start, end) of overlapping chunks.

    A chunk ends after the last paragraph break, else sentence, else line end in
    its second half; the next starts ``overlap`` characters before that.
    """
    if overlap * 2 >= size:
        raise ValueError("overlap must be less than half the size")
    return _borders(cut_chunks, size, overlap)(text)


def _heading_like(line: Column) -> Column:
    """A line if it looks like a heading, else an empty text."""
    upper = line.rlike(r"\p{Lu}") & ~line.rlike(r"[\p{Ll}\p{Lt}]") & (F.char_length(line) > 3)
    good = (F.char_length(line) <= 160) & (upper | line.rlike(r"^\d+(\.\d+)*\s+") | (line.endswith(":") & (F.char_length(line) < 80)))
    return F.when(good, line).otherwise("")


def heading(text: Column, start: Column) -> Column:
    """The nearest line that isn't blank within 2000 characters before ``start``, if it looks like a heading; else empty."""
    low = F.greatest(F.lit(0), start - HEADING_CHARS)
    lines = F.filter(F.transform(F.split(F.substring(text, low + 1, start - low), "\n"), strip), lambda x: x != "")
    return _heading_like(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))


def _line_before(text: str, start: int) -> str:
    """The nearest line that isn't blank within 2000 characters before ``start``."""
    before = text[max(0, start - HEADING_CHARS) : start].rstrip()
    return before[before.rfind("\n") + 1 :].lstrip()


def chunk_id(path: Column, mtime_ns: Column, start: Column, end: Column, text: Column) -> Column:
    """SHA-256 over the normalised path, time, offsets and a digest of the first 2000 characters."""
    head = F.sha2(F.left(text, F.lit(2000)), 256)
    return F.sha2(F.concat_ws("|", norm_path(path), mtime_ns.cast("string"), start.cast("string"), end.cast("string"), head), 256)


_CUT = pa.schema([("block", pa.int32()), ("chunk_index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("approx_start", pa.int32()), ("line", pa.string()), ("body", pa.string())])


def _cut(size: int, overlap: int, block: int, back: int):
    """Cut texts as rows: the columns before ``text``, then those of ``_CUT``."""
    def rows(text: str) -> Iterator[tuple]:
        for b, (first, stop) in enumerate(cut_blocks(text, block, back)):
            part, k = text[first:stop], 0
            for start, end in cut_chunks(part, size, overlap):
                if body := part[start:end].strip():
                    yield b, k, first + start, first + end, first + k * (size - overlap), _line_before(part, start), body
                    k += 1

    def run(batches):
        for batch in batches:
            kept = batch.select([c for c in batch.schema.names if c != "text"])
            owner, out, held = [], [], 0

            def told() -> pa.RecordBatch:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _CUT, strict=True)]
                return pa.RecordBatch.from_arrays([*kept.take(pa.array(owner)).columns, *columns], [*kept.schema.names, *_CUT.names])

            for at, text in enumerate(batch.column("text").to_pylist()):
                for row in rows(text or ""):
                    owner.append(at), out.append(row)
                    held += len(row[-1])
                    if held > _LOT:
                        yield told()
                        owner, out, held = [], [], 0
            if out:
                yield told()

    return run


def chunks(docs: DataFrame, size: int = 1200, overlap: int = 200, block: int = 200_000, back: int = 10_000) -> DataFrame:
    """``docs(source_path, mtime_ns, text)`` as chunk rows, without a shuffle.

    Adds ``block``, ``chunk_index``, ``start``, ``end`` (true offsets),
    ``approx_start``, ``heading``, ``chunk``, ``text_length`` and ``chunk_id``.
    Headings are not seen across blocks; blank chunks are dropped and not
    counted; a null text has none.
    """
    if overlap * 2 >= size:
        raise ValueError("overlap must be less than half the size")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("source_path", "mtime_ns"))
    cut = docs.select("source_path", "mtime_ns", "text").mapInArrow(_cut(size, overlap, block, back), f"{kinds}, block int, chunk_index int, start int, end int, approx_start int, line string, body string")
    rows = cut.withColumn("heading", _heading_like(F.col("line")))
    rows = rows.withColumn("chunk", F.when((F.col("heading") != "") & ~F.col("body").startswith(F.col("heading")), F.concat(F.lit("[SECTION] "), "heading", F.lit("\n"), "body")).otherwise(F.col("body")))
    return rows.select("source_path", "mtime_ns", "block", "chunk_index", "start", "end", "approx_start", "heading", "chunk", F.char_length("chunk").alias("text_length"), chunk_id(F.col("source_path"), F.col("mtime_ns"), F.col("start"), F.col("end"), F.col("chunk")).alias("chunk_id"))

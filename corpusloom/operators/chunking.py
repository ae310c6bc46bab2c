"""Overlapping chunks, cut at headings, blank lines, lines or words. All offsets count code points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 3200, 400
_KIND = "array<struct<seq:int,text:string,start_char:int>>"


def cut_before(text: str, start: int, limit: int) -> int:
    """The last natural boundary in the second half of text[start:limit], else limit."""
    half = start + (limit - start) // 2
    heads = [text.rfind(mark, half, limit) for mark in ("\n# ", "\n## ", "\n### ")]
    if (head := max(heads)) >= half:
        return head + 1  # the heading starts the next chunk
    for mark in ("\n\n", "\n", " "):
        if (at := text.rfind(mark, half, limit)) > half:
            return at
    return limit


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(from, to) of each chunk before its ends are trimmed."""
    size = size if size > 0 else SIZE
    overlap = overlap if 0 <= overlap < size else size // 8
    out, start, total = [], 0, len(text)
    while start < total:
        stop = total if start + size >= total else cut_before(text, start, start + size)
        out.append((start, stop))
        if stop == total:
            break
        start = stop - overlap if stop - overlap > start else stop
    return out


def pieces(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[dict]:
    kept = [(a, text[a:b].strip()) for a, b in spans(text or "", size, overlap)]
    return [{"seq": n, "text": t, "start_char": a} for n, (a, t) in enumerate((a, t) for a, t in kept if t)]


def chunked(df: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """A row a chunk: df's other columns, seq, text and start_char. Null, empty and blank texts have none."""

    @F.pandas_udf(_KIND)
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pieces(t, size, overlap))

    rest = [c for c in df.columns if c not in (text, "seq", "start_char")]
    return df.select(*rest, F.inline(cut(F.col(text))))

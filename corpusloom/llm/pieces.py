"""Problem 3: oversized items cut into pieces at natural boundaries.

Balanced targets: the least number of pieces is computed, targets of equal length are placed, each snaps to the
strongest boundary nearby (heading, paragraph, line, sentence, word), and a piece is added whenever a limit fails or a cut finds no
boundary that one more piece would give it. Lengths count code points of the canonical composition (NFC) without
white space at the ends. A piece starts exactly `overlap` code points before the last one's end, or a few more where
that would part a character from its marks.

A null or empty text isn't oversized. A doc_type that is missing or has no limits counts as html; a null or
non-positive limit means none; an overlap that is null or negative is 0, and one of max_chars/2 or more is
max_chars/8. Equal duplicate rows count once; other columns pass by untouched.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.stream import map_batches, merge

HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
_BOUNDARY = re.compile(r"(?P<h>\n(?=#{1,6}\s))|(?P<p>\n[^\S\n]*\n+)|(?P<l>\n)|(?P<s>(?<=[.!?…])[\"'”’»)\]]*[^\S\n]+|[。！？])|(?P<w>[^\S\n]+)")
_LEVEL = {"h": HEADING, "p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": WORD}
_MORE = 3


def measured(text: str | None) -> int:
    """Code points of the text in NFC, without white space at the ends."""
    if text is None:
        return 0
    t = text.strip()
    return len(t if t.isascii() else unicodedata.normalize("NFC", t))


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """(cut positions in order, their strength): a cut stands behind its white space, before the next piece's text."""
    at: list[int] = []
    level: list[int] = []
    for m in _BOUNDARY.finditer(text):
        rank = _LEVEL[m.lastgroup]
        if rank == PARAGRAPH and re.match(r"#{1,6}\s", text[m.end() : m.end() + 8]):
            rank = HEADING
        at.append(m.end())
        level.append(rank)
    return at, level


def _whole(text: str, i: int) -> int:
    """The last position up to i that parts no character from its marks or joiners."""
    while 0 < i < len(text) and (unicodedata.combining(text[i]) or text[i] in "\u200d\ufe0f" or text[i - 1] == "\u200d"):
        i -= 1
    return i


def cuts(text: str, start: int, end: int, most: int, overlap: int, marks: tuple[list[int], list[int]], count: int) -> tuple[list[int], int] | None:
    """count-1 cuts with every piece within the limit, and how many of them found no boundary; None if impossible."""
    at, level = marks
    got: list[int] = []
    hard, begin = 0, start
    for k in range(1, count):
        left = count - k
        last = got[-1] if got else start
        lo, hi = max(last + 1, begin + overlap + 1, end - left * (most - overlap)), min(begin + most, end - 1)
        if lo > hi:
            return None
        share = (end - begin + overlap * left) / (left + 1)
        target = min(max(round(begin + share), lo), hi)
        reach = max(1, most // 4)
        i, j = bisect.bisect_left(at, max(lo, target - reach)), bisect.bisect_right(at, min(hi, target + reach))
        if i < j:
            c = at[max(range(i, j), key=lambda x: (level[x], -abs(at[x] - target)))]
        else:
            i, j = bisect.bisect_left(at, lo), bisect.bisect_right(at, hi)
            if i < j:
                c = at[min(range(i, j), key=lambda x: abs(at[x] - target))]
            else:
                c, hard = _whole(text, target), hard + 1
                if c < lo:
                    c = target
        got.append(c)
        begin = _whole(text, c - overlap)
        if begin <= (got[-2] if len(got) > 1 else start) - overlap:
            return None
    return (got, hard) if end - begin <= most else None


def split(text: str | None, most: int, overlap: int) -> list[tuple[int, int]]:
    """(from, to) of each piece, in code points of text; one piece if it fits."""
    if not text or not text.strip():
        return []
    start = len(text) - len(text.lstrip())
    end = len(text.rstrip())
    if most is None or most <= 0 or measured(text) <= most:
        return [(start, end)]
    overlap = max(0, overlap or 0)
    if overlap * 2 >= most:
        overlap = most // 8
    marks = boundaries(text)
    least = max(2, -(-(end - start - overlap) // (most - overlap)))
    best = None
    for count in range(least, least + max(_MORE, least // 4) + 1):
        got = cuts(text, start, end, most, overlap, marks, count)
        if got and (best is None or got[1] < best[1]):
            best = got
        if best and not best[1]:
            break
    if best is None:  # marks that can't be parted fill a piece: cut at the limit, wherever that is
        step = most - overlap
        best = ([start + most + step * i for i in range((end - start - most + step - 1) // step)], 0)
        return [(max(start, c - overlap), d) for c, d in zip([start, *best[0]], [*best[0], end])]
    edges = best[0]
    return [(start if not i else _whole(text, c - overlap), d) for i, (c, d) in enumerate(zip([start, *edges], [*edges, end]))]


def _long(least: int):
    def fn(b: pa.RecordBatch) -> dict:
        sizes = [measured(t) for t in b["text"].to_pylist()]
        keep = [i for i, n in enumerate(sizes) if n > least]
        return {c: b[c].take(pa.array(keep, pa.int64())) for c in b.schema.names} | {"size": [sizes[i] for i in keep]}

    return fn


def _cut(b: pa.RecordBatch) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "chunk_id", "seq", "piece", "pieces", "start_char", "start_byte", "text")}
    rows = zip(*(b[c].to_pylist() for c in ("doc_id", "chunk_id", "seq", "text", "start_char", "start_byte", "max_chars", "overlap_chars")))
    for doc, chunk, seq, text, char, byte, most, overlap in rows:
        parts = split(text, most, overlap)
        done, size = 0, 0
        for n, (i, j) in enumerate(parts):
            if i >= done:
                size, done = size + len(text[done:i].encode("utf-8", "surrogatepass")), i
            else:
                size, done = size - len(text[i:done].encode("utf-8", "surrogatepass")), i
            row = (doc, chunk, seq, n, len(parts), None if char is None else char + i, None if byte is None else byte + size, text[i:j])
            for name, v in zip(out, row):
                out[name].append(v)
    return out


def limited(chunks: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """The chunks above their limit, with size, max_chars and overlap_chars.

    Each text is measured where it is read; only those above the least of all limits are moved to their docs."""
    kind = F.lower(F.trim(F.coalesce(F.nullif(F.trim("doc_type"), F.lit("")), F.lit("html"))))
    lim = limits.groupBy(kind.alias("kind")).agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    lim = {r.kind: (r.max_chars, r.overlap_chars) for r in lim.collect()}  # settings: a row a type
    html = lim.get("html", (None, None))
    lim = {k: html if v[0] is None else v for k, v in lim.items()}
    least = min((m for m, _ in [*lim.values(), html] if m and m > 0), default=None)
    cols = ("doc_id", "chunk_id", "seq", "text", "start_char", "start_byte")
    texts = chunks.select("doc_id", "chunk_id", F.col("seq").cast("int").alias("seq"), "text", F.col("start_char").cast("long").alias("start_char"), F.col("start_byte").cast("long").alias("start_byte"))
    # composition makes a text at most three times as long
    texts = texts.where(F.length("text") * 3 > F.lit(least if least is not None else 1 << 31))
    schema = "doc_id long, chunk_id long, seq int, text string, start_char long, start_byte long, size long"
    long = map_batches(texts, _long(least or 0), schema).distinct()
    of_doc = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(kind).alias("kind"))
    known = merge(long).join(merge(of_doc), "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit("html")))
    table = docs.sparkSession.createDataFrame([(k, m, o, True) for k, (m, o) in lim.items()], "kind string, max_chars int, overlap_chars int, listed boolean")
    known = known.join(F.broadcast(table), "kind", "left")
    either = lambda c, other: F.when(F.col("listed"), F.col(c)).otherwise(F.lit(other)).cast("int").alias(c)
    known = known.select(*cols, "size", either("max_chars", html[0]), either("overlap_chars", html[1]))
    return known.where("max_chars > 0 AND size > max_chars")


def pieces(chunks: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, seq, piece, pieces, start_char, start_byte, text): the pieces of every oversized chunk."""
    schema = "doc_id long, chunk_id long, seq int, piece int, pieces int, start_char long, start_byte long, text string"
    return map_batches(limited(chunks, docs, limits), _cut, schema)

"""Problem 6: one form for all strings that look the same.

The skeleton of a text: decompose (NFD, with width forms, ligatures and font variants of letters by their compatibility
decomposition), replace every character by its prototype from the look-alike table, decompose again. Texts with
equal skeletons look alike. Kinds of blanks become one blank each, line ends become a line feed, and invisible
characters go; a joiner between two pictographs stays, as it changes what is drawn. Accents, letter case, words,
line breaks and the number of blanks are kept apart.

The look-alike table is the public confusables data (UTS #39) as Spark's ICU library brings it, or a file in its published format; without either there is an error,
as forms made without the data would look like results. A short list of Cyrillic, Greek, Armenian and Cherokee letters comes on top. Of that data letters with one letter as prototype are taken: its classes of
ASCII characters (I and l, rn and m) and of marks hold for identifiers, but differ in running text.

A null value has no skeleton and no pairs; the empty text looks like a text of invisible characters only. Equal
duplicate rows count once. Whole texts are compared, by two independent 64-bit hashes of skeleton and text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.stream import map_batches, merge
from corpusloom.plans.shared import materialize

# Letters of other scripts (left) that are drawn as the Latin letters below them.
CYRILLIC = "аеорсухіѕјһԁԛԝѵАВЕКМНОРСТХІЅЈԚԜҮѴԌ"
CYRILLIC_AS = "aeopcyxisjhdqwvABEKMHOPCTXISJQWYVG"
GREEK = "οανρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ"
GREEK_AS = "oavpcjABEZHIKMNOPTYXC"
ARMENIAN = "օսհոցզՕՏԼ"
ARMENIAN_AS = "ouhngqOSL"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"

_SOFT = {"<wide>", "<narrow>", "<font>"}
_BLANKS = {"\t"} | {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Zs"}
_BREAKS = "\r\u0085\u2028\u2029\x0b\x0c"
_JOINER = "\u200d"


def _invisible(c: int) -> bool:
    """Default-ignorable characters: format characters, fillers and variation selectors."""
    ch = chr(c)
    if unicodedata.category(ch) == "Cf":
        return not (0x0600 <= c <= 0x0605 or c in (0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD) or 0xFFF9 <= c <= 0xFFFB)
    return c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0F or 0xE0000 <= c <= 0xE0FFF


@functools.cache
def prototypes() -> dict[int, str | None]:
    """Prototype of every character that isn't its own."""
    out: dict[int, str | None] = {}
    for c in range(0x80, sys.maxunicode + 1):
        kind, _, rest = unicodedata.decomposition(chr(c)).partition(" ")
        if kind in _SOFT or kind == "<compat>" and "LIGATURE" in unicodedata.name(chr(c), "") and 0xFB00 <= c <= 0xFB17:
            out[c] = unicodedata.normalize("NFKD", chr(c))
        elif _invisible(c):
            out[c] = None
    out[0xAD] = None
    out.update({0x2010: "-", 0x2011: "-"})
    for one, other in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS)):
        out.update((ord(a), b) for a, b in zip(one, other, strict=True))
    out.update((ord(b), " ") for b in _BLANKS)
    out.update((ord(b), "\n") for b in _BREAKS)
    for c in range(32):
        if chr(c) not in "\n\t" + _BREAKS:
            out[c] = None
    out[0x7F] = None
    return out


def _letters(pairs) -> dict[int, str]:
    """Of (character, prototype) the letters outside ASCII that stand for one other letter; capitals drawn as a stroke are I."""
    out: dict[int, str] = {}
    for a, b in pairs:
        kind = unicodedata.category(a)
        if a > "\x7f" and len(b) == 1 and a != b and kind in ("Lu", "Ll", "Lt", "Lo", "Nl") and (b.isalpha() or b == "O"):
            out[ord(a)] = "I" if b == "l" and kind in ("Lu", "Lt") else b
    return out


def look_alikes(spark: SparkSession, path: str | None = None) -> dict[int, str]:
    """Prototypes of look-alike letters, by the file of public confusables at path or the data of Spark's ICU; a few thousand, whatever the input."""
    if path:
        rows = (r.value.split("#")[0].split(";") for r in spark.read.text(path).collect())
        read = lambda x: "".join(chr(int(c, 16)) for c in x.split())
        return _letters((read(r[0]), read(r[1])) for r in rows if len(r) >= 2 and len(r[0].lstrip("\ufeff").split()) == 1)
    chars = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L" or unicodedata.category(chr(c)) == "Nl"]
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        found = checker.getSkeleton(0, "\n".join(chars)).split("\n")
    except Exception as e:  # a build without ICU, or a call that failed
        raise RuntimeError("the look-alike data can't be read from Spark's ICU library; name a file of the public confusables") from e
    return _letters(zip(chars, found, strict=True))


def _pictograph(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk") or ch == "\ufe0f"


def _split_joined(text: str) -> str:
    """Joiners between pictographs become a private mark that the table keeps."""
    at = text.find(_JOINER, 1)
    if at < 0:
        return text
    parts = list(text)
    while 0 < at < len(text) - 1:
        if _pictograph(text[at - 1]) and _pictograph(text[at + 1]):
            parts[at] = "\x00"
        at = text.find(_JOINER, at + 1)
    return "".join(parts)


@functools.cache
def _table() -> dict[int, str | None]:
    return prototypes() | {0: "\U0010fffe"}


def table(letters: dict[int, str]) -> dict[int, str | None]:
    """The short list and the rules of forms, blanks and invisible characters, over the public data."""
    return letters | _table()


def skeleton(text: str, table: dict[int, str | None] | None = None) -> str:
    if text.isascii() and text.isprintable():
        return text
    text = text.replace("\x00", "")
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    table = _table() if table is None else table
    if not text.isascii():
        text = unicodedata.normalize("NFD", _split_joined(text))
        return unicodedata.normalize("NFD", text.translate(table))
    return text.translate(table)


def hashed(values: DataFrame, confusables: str | None = None) -> DataFrame:
    """Of rows (field, id, value): (field, id, s1, s2, v1, v2), hashes of the skeleton and of the value."""
    rows = values.select("field", F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value")).where("value IS NOT NULL AND id IS NOT NULL")
    letters = values.sparkSession.sparkContext.broadcast(look_alikes(values.sparkSession, confusables))
    low = lambda x: x - (1 << 64) if x >> 63 else x

    def fn(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("field", "id", "s1", "s2", "v1", "v2")}
        forms = table(letters.value)
        for field, i, text in zip(b["field"].to_pylist(), b["id"].to_pylist(), b["value"].to_pylist()):
            raw, form = text.encode("utf-8", "surrogatepass"), skeleton(text, forms).encode("utf-8", "surrogatepass")
            s, v = xxhash.xxh3_128_intdigest(form), xxhash.xxh3_128_intdigest(raw)
            for name, x in zip(out, (field, i, low(s >> 64), low(s & (1 << 64) - 1), low(v >> 64), low(v & (1 << 64) - 1))):
                out[name].append(x)
        return out

    return map_batches(rows, fn, "field string, id long, s1 long, s2 long, v1 long, v2 long")


def groups(values: DataFrame) -> DataFrame:
    """Rows whose skeleton is shared by two or more different values, each row once."""
    h = materialize(hashed(values), "forms")
    key = ["field", "s1", "s2"]
    several = h.groupBy(key).agg(F.min("v1").alias("lo"), F.max("v1").alias("hi"), F.min("v2").alias("lo2"), F.max("v2").alias("hi2")).where("lo <> hi OR lo2 <> hi2")
    return merge(h).join(merge(several.select(key)), key).select(h.columns).distinct()


def pairs(values: DataFrame) -> DataFrame:
    """(field, id_a, id_b), smaller id first: rows that look the same and aren't equal."""
    g = groups(values)
    a, b = g.toDF("field", "id_a", "s1", "s2", "va1", "va2"), g.toDF("field", "id_b", "s1", "s2", "vb1", "vb2")
    both = merge(a).join(merge(b), ["field", "s1", "s2"]).where("id_a < id_b AND (va1 <> vb1 OR va2 <> vb2)")
    return both.select("field", "id_a", "id_b").distinct()


def unified(values: DataFrame, confusables: str | None = None) -> DataFrame:
    """(field, id, form): every value in the one form, composed; null stays null."""
    rows = values.select("field", F.col("id").cast("long").alias("id"), F.col("value").cast("string").alias("value"))
    letters = values.sparkSession.sparkContext.broadcast(look_alikes(values.sparkSession, confusables))

    def fn(b: pa.RecordBatch) -> dict:
        forms = table(letters.value)
        return {"field": b["field"], "id": b["id"], "form": [None if t is None else unicodedata.normalize("NFC", skeleton(t, forms).replace("\U0010fffe", _JOINER)) for t in b["value"].to_pylist()]}

    return map_batches(rows, fn, "field string, id long, form string").distinct()


def values(serp: DataFrame, chunks: DataFrame) -> DataFrame:
    """The three fields as rows (field, id, value)."""
    part = lambda df, field, i: df.select(F.lit(field).alias("field"), F.col(i).alias("id"), F.col(field).alias("value"))
    return part(serp, "title", "result_id").unionByName(part(serp, "snippet", "result_id")).unionByName(part(chunks, "text", "chunk_id"))

"""Words of queries and texts, and their stems."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

QUERY_WORDS = 10


def query_words(q: str, limit: int = QUERY_WORDS) -> list[str]:
    """The first words of a query in lower case; repeated words stay and count again."""
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", q.lower())[:limit]


def words(text: Column) -> Column:
    """Words in lower case, JVM-side: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


@functools.lru_cache(1 << 16)
def folded(word: str) -> str:
    """Lower case without diacritics that stand on a letter."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)) if not word.isascii() else word.lower()


# Porter's algorithm (1980): suffix rules by step; m counts vowel-consonant sequences of the stem.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(w: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _kinds(w)))


def _cvc(w: str) -> bool:
    return len(w) >= 3 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    for end in sorted((e for e in table if w.endswith(e)), key=len, reverse=True)[:1]:
        stem = w[: len(w) - len(end)]
        return stem + table[end] if _measure(stem) >= least else w
    return w


@functools.lru_cache(1 << 18)
def stem(w: str) -> str:
    """Porter stem of a word in lower case; words with other letters and short ones stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ing", "ed") if w.endswith(e) and "v" in _kinds(w[: -len(e)])), None)
        if end:
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2, 1), _STEP3, 1)
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default="")
    if end:
        base = w[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
            w = base
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(text: str | None) -> list[str]:
    """Folded stems of a text's words, in order."""
    if not text:
        return []
    return [stem(folded(x)) for x in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", text))]


@F.pandas_udf(ArrayType(StringType()))
def stemmed(s: pd.Series) -> pd.Series:
    return s.map(stems)

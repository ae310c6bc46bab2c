"""Prompt-injection risk: scored rules, levels, and their fold over several texts.

Rules stay native regular expressions inside generated code, so a filter on the level needs no Python. The patterns are
written in RE2's dialect and translated to Java's, whose word boundaries, white space, line ends and case folding differ."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name, weight and pattern of each rule, in the order in which signals are reported.
RULES: tuple[tuple[str, int, str], ...] = (
    ("instruction-override", 5, r"(?i)\b(ignore|disregard|forget|override)\b[\s\S]{0,40}\b(previous|prior|above|earlier|all|any|your|system)\b[\s\S]{0,40}\b(instructions?|prompts?|rules?|guidelines?|messages?)\b"),
    ("new-instructions", 4, r"(?i)\b(new|updated|revised|replacing)\s+instructions?\s*[:\.]"),
    ("fake-role-line", 4, r"(?im)^\s*(system|assistant|user|developer|tool)\s*:\s"),
    ("fake-role-tag", 4, r"(?i)<\s*(system|assistant|instructions|system-prompt)\s*>"),
    ("chat-template-token", 6, r"<\|[^|>]{1,32}\|>"),
    ("persona-hijack", 3, r"(?i)\byou\s+are\s+now\b|\bpretend\s+(you|to)\b|\bDAN\s+mode\b|\bjailbreak\b|\bact\s+as\s+if\s+you\s+(are|were)\b"),
    (
        "system-prompt-exfil",
        5,
        r"(?i)\b(system\s*prompt|hidden\s*instructions?|initial\s*prompt)\b.{0,60}\b(show|print|repeat|reveal|output|leak|export)\b|\b(show|print|repeat|reveal|output|leak|export)\b.{0,60}\b(system\s*prompt|hidden\s*instructions?)\b",
    ),
    ("url-tool-call", 3, r"(?i)\b(fetch|open|navigate\s+to|visit|POST|GET\s+https?)\b[^\n]{0,80}\bhttps?\s*:(?:/{1,3}|\\{1,3})"),
    ("credential-string", 4, r"\b(?:sk|pk|ghp|gho|github_pat|x-api-key|api[_-]?key|authorization)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-\.]{12,}"),
    ("base64-block", 2, r"[A-Za-z0-9+/]{120,}={0,2}"),
    ("control-sequence-bracket", 3, r"\x1b\[[0-9;]*[A-Za-z]"),
    ("tool-forgery", 5, r"(?i)\btool[_\s]?use\b|\"role\"\s*:\s*\"(system|assistant)\""),
)
LEVELS = ("none", "low", "medium", "high")
MEDIUM_FROM, HIGH_FROM = 4, 8

_EDGE = r"(?-iu:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_BLANK = r"\t\n\f\r "


def java_pattern(re2: str) -> str:
    """The pattern with RE2's meaning for Java's engine."""
    flags = re.match(r"\(\?([a-z]+)\)", re2)
    names, body = (flags[1], re2[flags.end() :]) if flags else ("", re2)
    out, inside, i = [], False, 0
    while i < len(body):
        if body.startswith(r"[\s\S]", i):
            out.append(r"[\s\S]")
            i += 6
            continue
        pair = body[i : i + 2]
        if pair == r"\b" and not inside:
            out.append(_EDGE)
        elif pair == r"\s":
            out.append(_BLANK if inside else f"[{_BLANK}]")
        elif body[i] == "\\":
            out.append(pair)
        else:
            inside = body[i] == "[" or (inside and body[i] != "]")
            out.append(body[i])
            i += 1
            continue
        i += 2
    return f"(?{names}{'u' if 'i' in names else ''}d)" + "".join(out)


def signals(text: Column) -> Column:
    """Names of the rules that fire, in rule order; an empty array for null."""
    return F.array_compact(F.array(*(F.when(text.rlike(java_pattern(p)), F.lit(n)) for n, _, p in RULES)))


def score(text: Column) -> Column:
    """Sum of the weights of the rules that fire; 0 for null."""
    total = F.lit(0)
    for _, weight, p in RULES:
        total = total + F.when(text.rlike(java_pattern(p)), weight).otherwise(0)
    return total


def score_of(names: Column) -> Column:
    """The score from signal names that are known already."""
    total = F.lit(0)
    for n, weight, _ in RULES:
        total = total + F.when(F.array_contains(names, n), weight).otherwise(0)
    return total


def level(points: Column) -> Column:
    return F.when(points >= HIGH_FROM, "high").when(points >= MEDIUM_FROM, "medium").when(points > 0, "low").otherwise("none")


def rank(name: Column) -> Column:
    """0..3 for none..high; anything else counts as none."""
    return F.coalesce(*(F.when(name == x, i) for i, x in enumerate(LEVELS)), F.lit(0))


def assessed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with signals, score and suspicion; the rules are evaluated once."""
    return df.withColumn("signals", signals(F.col(text))).withColumn("score", score_of(F.col("signals"))).withColumn("suspicion", level(F.col("score")))


def folded(df: DataFrame, by: list[str], order: list[str], suspicion: str = "suspicion", names: str = "signals") -> DataFrame:
    """One row a group: the highest level, and the signals of the rows at that level, each once, in order."""
    top = F.max(rank(F.col(suspicion))).alias("top") if not by else None
    if by:
        rows = df.withColumn("_r", rank(F.col(suspicion))).withColumn("_top", F.max("_r").over(Window.partitionBy(*by)))
    else:
        rows = df.withColumn("_r", rank(F.col(suspicion))).crossJoin(F.broadcast(df.agg(F.coalesce(top, F.lit(0)).alias("_top"))))
    rows = rows.where(F.col("_r") == F.col("_top"))
    # names at the top level: a name's place is that of its first row, then its place in it
    first = rows.select(*by, "_top", F.struct(*order).alias("_o"), F.posexplode_outer(names).alias("_p", "_n"))
    first = first.groupBy(*by, "_top", "_n").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    out = first.groupBy(*by, "_top").agg(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_at", "_n")))).alias("_all"))
    names_of = F.when(F.col("_top") > 0, F.transform("_all", lambda x: x["_n"])).otherwise(F.array().cast("array<string>"))
    return out.select(*by, F.get(F.array(*map(F.lit, LEVELS)), F.col("_top")).alias("suspicion"), names_of.alias("signals"))

"""Stored pages: types, challenges, robots, caps and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses and body fingerprints of bot walls.
CHALLENGE_STATUS = (202, 401, 403, 407, 408, 429, 503)
CHALLENGE_MARKERS = ("anomaly-modal", "challenge-platform", "cf-challenge", "cf_chl_", "just a moment", "g-recaptcha", "grecaptcha", "hcaptcha", "px-captcha", "perimeterx", "verify you are human", "enable javascript and cookies to continue", "_cf_chl_opt", "datadome", "captcha-delivery")
TYPES = ("html", "pdf", "markdown", "text", "binary")


def document_type(content_type: Column, body: Column) -> Column:
    """html, pdf, markdown, text or binary, from the declared type and the first 512 characters of the body."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.substring(F.coalesce(body, F.lit("")), 1, 512)
    low = F.lower(head)
    return (
        F.when(head.startswith("%PDF-"), "pdf")
        .when(kind.contains("html") | kind.contains("xml") | low.contains("<!doctype html") | low.contains("<html"), "html")
        .when(kind.contains("markdown"), "markdown")
        .when(kind.contains("json") | kind.contains("text") | (kind == "") | ~head.contains("\0"), "text")
        .otherwise("binary")
    )


def challenge_status(status: Column) -> Column:
    return status.isin(*CHALLENGE_STATUS)


def challenge_body(body: Column) -> Column:
    low, hit = F.lower(body), F.lit(False)
    for m in CHALLENGE_MARKERS:
        hit = hit | low.contains(m)
    return F.coalesce(hit, F.lit(False))


def challenged(status: Column, body: Column) -> Column:
    return F.coalesce(challenge_status(status), F.lit(False)) | challenge_body(body)


def within_cap(body: Column, cap: int) -> Column:
    """False where the body has more bytes than the cap: such rows go to the rejects, they aren't cut."""
    return F.coalesce(F.octet_length(body) <= cap, F.lit(True))


def first_page(plain: Column, rendered: Column) -> Column:
    """The plain fetch, or the rendered page where the plain one is missing or challenged."""
    return F.when(plain.isNotNull() & ~challenge_body(plain), plain).otherwise(rendered)


def robots_blocked(body: Column) -> Column:
    """Whether a group for all agents disallows the whole site. Consecutive User-agent lines form one group.

    Other agents' groups, Allow lines and partial paths don't block; a null body allows everything."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    field = lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1)))
    value = lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, "^[^:]*:(.*)$", 1), r"^\s+|\s+$", ""))
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("ours"), F.lit(False).alias("hit"))

    def step(s: Column, x: Column) -> Column:
        agent, rule = field(x) == "user-agent", x.contains(":")
        ours = F.when(agent, (value(x) == "*") | (s["open"] & s["ours"])).otherwise(s["ours"])
        hit = s["hit"] | ((field(x) == "disallow") & ours & value(x).isin("/", "/*"))
        return F.struct(F.when(rule, agent).otherwise(s["open"]).alias("open"), ours.alias("ours"), hit.alias("hit"))

    return F.coalesce(F.aggregate(lines, start, step, lambda s: s["hit"]), F.lit(False))


def on_allowlist(name: Column, hosts: list[str]) -> Column:
    """The host is one of the list or below one."""
    low = F.lower(name)
    hit = low.isin(*hosts)
    for h in hosts:
        hit = hit | low.endswith("." + h)
    return hit


def scheduled(requests: DataFrame, host: str, order: list[str], per_second: float) -> DataFrame:
    """requests with the seconds after which each may start: one slot every 1/per_second for each host."""
    n = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return requests.withColumn("start_after", (n - 1) / F.lit(float(per_second)))


def robots_closed(body: str | None) -> bool:
    """robots_blocked for one body, on an executor without a session."""
    ours = opened = False
    for line in (body or "").split("\n"):
        key, colon, value = (x.strip() for x in line.split("#", 1)[0].partition(":"))
        if not colon:
            continue
        agent = key.lower() == "user-agent"
        if agent:
            ours = value == "*" or (opened and ours)
        elif key.lower() == "disallow" and ours and value in ("/", "/*"):
            return True
        opened = agent
    return False

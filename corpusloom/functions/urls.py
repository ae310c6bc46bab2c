"""URLs: admission, identity, domains and encodings, as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
# Fixed value: second-level suffixes below which names are registered, besides plain top-level domains.
TWO_PART_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 user info, 3 host and port, 4 path, 5 query with its question mark; empty if there is none."""
    return F.regexp_extract(url, _PARTS, n)


def host(url: Column) -> Column:
    """Host in lower case, without port."""
    return F.lower(F.regexp_replace(part(url, 3), r":\d*$", ""))


def admissible(url: Column) -> Column:
    """http or https with a host and without user info; null is not."""
    good = F.lower(part(url, 1)).isin("http", "https") & (part(url, 3) != "") & ~url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*@")
    return F.coalesce(good, F.lit(False))


def normalized(url: Column) -> Column:
    """Identity of a result: host without www., decoded path without closing slashes, query; other text in lower case."""
    path = F.coalesce(F.try_url_decode(F.replace(part(url, 4), F.lit("+"), F.lit("%2B"))), part(url, 4))
    key = F.concat(F.regexp_replace(F.lower(part(url, 3)), r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(F.length(part(url, 5)) > 1, part(url, 5)).otherwise(F.lit("")))
    return F.when(url.rlike(_PARTS), key).otherwise(F.lower(url))


def registrable(name: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    """Domain under its public suffix, in lower case; empty for a suffix itself or no dot."""
    low = F.lower(name)
    two = F.substring_index(low, ".", -2)
    three = F.substring_index(low, ".", -3)
    return F.when(~low.contains("."), F.lit("")).when(two.isin(*suffixes), F.when(low == two, F.lit("")).otherwise(three)).otherwise(two)


def public_suffix_rules(lines: list[str]) -> set[str]:
    """Rules of a public-suffix list in its published format: comments and blank lines are skipped, * and ! keep their meaning."""
    return {x.split()[0].lower() for x in lines if x.strip() and not x.startswith("//")}


def suffix_of(name: str | None, rules: set[str]) -> str:
    """The longest matching suffix; an exception names the one above it; the last label where no rule matches."""
    labels = (name or "").lower().strip(".").split(".")
    for i in range(len(labels)):
        own, wild = ".".join(labels[i:]), ".".join(["*", *labels[i + 1 :]])
        if f"!{own}" in rules:
            return ".".join(labels[i + 1 :])
        if own in rules or (wild in rules and i + 1 < len(labels)):
            return own
    return labels[-1]


def domain_of(name: str | None, rules: set[str]) -> str:
    """The label before the public suffix and the suffix; empty for a suffix itself."""
    low, suffix = (name or "").lower().strip("."), suffix_of(name, rules)
    head = low[: -len(suffix) - 1] if suffix and low.endswith("." + suffix) else ""
    return f"{head.rsplit('.', 1)[-1]}.{suffix}" if head else ""


def domains_by(name: Column, rules: set[str]) -> Column:
    """(suffix, domain) of each host by a public-suffix list, which is read on the driver and bounded by itself."""

    @F.pandas_udf("struct<suffix:string,domain:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"suffix": [suffix_of(x, rules) for x in s], "domain": [domain_of(x, rules) for x in s]})

    return run(name)


def unwrapped(href: Column, parameter: str = "uddg") -> Column:
    """The target that a redirecting link carries in a parameter, else the link."""
    raw = F.regexp_extract(href, rf"[?&]{parameter}=([^&#]*)", 1)
    target = F.try_url_decode(raw)
    return F.when(target != "", target).otherwise(href)


def link_admissible(link: Column) -> Column:
    return F.trim(link).rlike("^https?://")


def outgoing(links: Column) -> Column:
    """Admissible links, trimmed, each once, first places kept."""
    return F.array_distinct(F.filter(F.transform(links, lambda x: F.trim(x)), lambda x: x.rlike("^https?://")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def is_private_address(s: str | None) -> bool | None:
    """Private, loopback, link-local, multicast or unspecified addresses and the metadata address; null if unreadable."""
    try:
        ip = ipaddress.ip_address((s or "").strip().strip("[]"))
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.version == 4:
        nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
    else:
        nets = ("fc00::/7",)
    return any(ip in ipaddress.ip_network(n) for n in nets) or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified


@F.pandas_udf(BooleanType())
def private_address(s: pd.Series) -> pd.Series:
    return s.map(is_private_address)


def deduplicated(results: DataFrame, by: list[str], order: list[str], url: str = "url", limit: int | None = None) -> DataFrame:
    """First result of each identity in order, renumbered 1..n as rank; results without identity are dropped."""
    key = normalized(F.col(url))
    rows = results.withColumn("_key", key).where("_key IS NOT NULL AND _key <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))).where("_n = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if limit is not None:
        rows = rows.where(F.col("rank") <= max(1, limit))
    return rows.drop("_key", "_n")

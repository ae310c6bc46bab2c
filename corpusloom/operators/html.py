"""HTML to a tree, and the tree to Markdown, plain text, title and links.

The tree builder is tolerant: void elements, implied ends of p, li, table and option parts, raw text in scripts and styles,
and stray end tags. Formatting elements left open end with their block instead of being opened again in the next."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("script style noscript svg template link meta iframe canvas form button nav footer".split())
SKIPPED = NOISE | frozenset("input select textarea aside dialog video audio source track".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_HEADS = {f"h{i}": i for i in range(1, 7)}
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_P_ENDERS = BLOCK - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt"}
_BLANKS = re.compile(r"[ \t\r\n\f\v]+")
USABLE = 40


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    def walk(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.walk()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _P_ENDERS:
            self._close({"p"}, BLOCK - {"p"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].kids.append(Node("p"))
        self._close({tag}, set() if tag in BLOCK else {"td", "th", "table"})

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parsed(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or "display:none" in style or "visibility:hidden" in style


def stripped(n: Node) -> Node:
    """A copy without noise elements and hidden nodes."""
    out = Node(n.tag, n.attrs)
    out.kids = [k if isinstance(k, str) else stripped(k) for k in n.kids if isinstance(k, str) or not (k.tag in NOISE or hidden(k))]
    return out


def title(root: Node) -> str:
    first = next(iter(root.find("title")), None)
    return "".join(k for k in first.kids if isinstance(k, str)).strip() if first else ""


def links(root: Node) -> list[str]:
    """Absolute links of the page without its noise, each once, in order."""
    found = (n.attrs.get("href", "").strip() for n in stripped(root).find("a"))
    return list(dict.fromkeys(h for h in found if h.startswith(("http://", "https://"))))


class _Writer:
    """Blocks are collected as finished strings; inline content as one string that may hold line ends of br."""

    def __init__(self, plain: bool):
        self.plain = plain

    def inline(self, n: Node, pre: bool = False) -> str:
        parts: list[str] = []
        for k in n.kids:
            s = self._inline_of(k, pre)
            if s and not pre and s[0] == " " and (not parts or parts[-1][-1:] in (" ", "\n")):
                s = s[1:]
            if s:
                parts.append(s)
        return "".join(parts)

    def _inline_of(self, k, pre: bool) -> str:
        if isinstance(k, str):
            return k if pre else _BLANKS.sub(" ", k.replace("\xa0", " "))
        tag = k.tag
        if tag in SKIPPED:
            return ""
        if tag == "br":
            return "  \n"
        if tag == "img":
            src = k.attrs.get("src", "")
            return f"![{k.attrs.get('alt') or 'image'}]({src})" if src and not self.plain else ""
        body = self.inline(k, pre)
        if self.plain:
            return body
        flat = body.replace("\n", " ").replace("\r", " ")
        if tag in _MARKS:
            return f"{_MARKS[tag]}{flat}{_MARKS[tag]}" if body.strip() else body
        if tag == "code" and not pre:
            return f"`{body}`"
        if tag == "a":
            href, text = k.attrs.get("href", ""), body.strip()
            if not href or href.lower() == "javascript:void(0)":
                return body
            return f"<{href}>" if text in ("", href) else f"[{text.replace(chr(10), ' ').replace(chr(13), ' ')}]({href})"
        return body

    def blocks(self, n: Node, depth: int = 0) -> list[str]:
        """The blocks below n; runs of inline children between block children are paragraphs of their own."""
        out: list[str] = []
        run = Node("#run")

        def flush() -> None:
            s = self.inline(run).strip(" ")
            if s.strip():
                out.append(s.rstrip(" ").lstrip("\n"))
            run.kids = []

        for k in n.kids:
            if isinstance(k, str) or not self._holds_block(k):
                run.kids.append(k)
                continue
            flush()
            out += self._block(k, depth)
        flush()
        return out

    def _holds_block(self, n: Node) -> bool:
        return n.tag not in SKIPPED and (n.tag in BLOCK or any(isinstance(k, Node) and self._holds_block(k) for k in n.kids))

    def _block(self, n: Node, depth: int) -> list[str]:
        tag = n.tag
        if tag in _HEADS:
            body = self.inline(n).strip()
            return [body if self.plain else f"{'#' * _HEADS[tag]} {body}"] if body else []
        if tag == "hr":
            return [] if self.plain else ["---"]
        if tag == "pre":
            return self._pre(n)
        if tag == "blockquote":
            inner = "\n\n".join(self.blocks(n, depth)).strip()
            return ["\n".join(inner.split("\n") if self.plain else [f"> {x}" for x in inner.split("\n")])] if inner else []
        if tag in ("ul", "ol"):
            return self._items(n, depth)
        if tag == "table":
            return self._table(n)
        if tag == "li":
            return self._item(n, "- ", depth)
        return self.blocks(n, depth)

    def _pre(self, n: Node) -> list[str]:
        if self.plain:
            return [self.inline(n).strip(" ")]
        code = next((k for k in n.kids if isinstance(k, Node) and k.tag == "code"), None)
        names = (code.attrs.get("class", "") if code else "").split()
        lang = next((c[len(p) :] for c in names for p in ("language-", "lang-", "highlight-") if c.startswith(p)), "")
        return [f"```{lang}\n{self.inline(code or n, True).rstrip(' ')}\n```"]

    def _items(self, n: Node, depth: int) -> list[str]:
        out, number = [], 0
        for k in n.kids:
            if not isinstance(k, Node) or k.tag in SKIPPED:
                continue
            if k.tag == "li":
                number += 1
                out += self._item(k, f"{number}. " if n.tag == "ol" else "- ", depth)
            else:
                out += self._block(k, depth + 1) if self._holds_block(k) else []
        return out

    def _item(self, n: Node, mark: str, depth: int) -> list[str]:
        """The item's first block behind its mark; nested lists and further blocks follow as blocks."""
        own = self.blocks(n, depth + 1)
        head = own.pop(0) if own and not own[0].startswith(" " * 4 * (depth + 1)) else ""
        return [" " * 4 * depth + (mark + head).rstrip(" "), *own]

    def _table(self, n: Node) -> list[str]:
        rows = [[self._cell(c) for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.find("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return []
        width = max(map(len, rows))
        full = [r + [""] * (width - len(r)) for r in rows]
        if self.plain:
            return ["\n".join("  ".join(r) for r in full)]
        lines = [f"| {' | '.join(r)} |" for r in full]
        return ["\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]

    def _cell(self, n: Node) -> str:
        body = " ".join(self.blocks(n)).strip().replace("\n", " ")
        return body.replace("|", "\\|")


def rendered(n: Node, plain: bool = False) -> str:
    out = "\n\n".join(_Writer(plain).blocks(n)).replace("\xa0", " ")
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _density(n: Node) -> float:
    """Characters of running text, less those of links, with commas as a sign of sentences."""
    text = sum(len(p.text().strip()) + 10 * p.text().count(",") for p in n.find("p", "pre", "blockquote", "li"))
    return text - 2 * sum(len(a.text()) for a in n.find("a"))


def main_content(root: Node) -> Node:
    """article or main if they hold most of the text, else the densest container."""
    body = next(iter(root.find("body")), root)
    clean = stripped(body)
    named = clean.find("article", "main")
    pool = named or [n for n in clean.find("div", "section", "td")]
    best = max(pool, key=_density, default=clean)
    return best if _density(best) >= 0.5 * _density(clean) and best.text().strip() else clean


def extracted(html: str | None) -> dict:
    """title, markdown, plain, links and how the content was found: readability, or fallback to the whole page."""
    root = parsed(html)
    body = next(iter(root.find("body")), root)
    markdown = rendered(main_content(root))
    how = "readability" if len(markdown) > USABLE and markdown.strip() else "fallback"
    whole = stripped(body)
    if how == "fallback":
        markdown = rendered(whole)
    return {"title": title(root), "markdown": markdown, "plain": rendered(whole, True), "links": links(root), "extraction": how}


_KIND = StructType().add("title", StringType()).add("markdown", StringType()).add("plain", StringType()).add("links", ArrayType(StringType())).add("extraction", StringType())


@F.pandas_udf(_KIND)
def extract(html: pd.Series) -> pd.DataFrame:
    """The page parsed once; a null page gives empty fields."""
    return pd.DataFrame(list(html.map(extracted)), columns=["title", "markdown", "plain", "links", "extraction"])


def fast_title(html: Column) -> Column:
    """The title without building a tree."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1))


def without_noise(html: Column) -> Column:
    """The page without noise elements, for well-formed markup, without building a tree."""
    pairs = "|".join(sorted(NOISE - VOID))
    return F.regexp_replace(html, rf"(?is)<({pairs})\b[^>]*>.*?</\1\s*>|<(?:link|meta)\b[^>]*>", "")

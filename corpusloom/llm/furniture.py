"""Problem 7: page boilerplate mixed with main content.

Wrapper induction. A page's text is read back as a tree: blocks between blank lines, lines, and the cells of a line (menu
entries between separators or in links). Pages of one host are aligned with some of the host's pages by simple tree
matching. Nodes that stay the same become its template, if they stand where a template does: from the page's start on, from
its end back, or as the head of a box of short entries. Varying slots are the host's own name, digits, what follows a menu
entry in a trail, and the entries of a box. A template of many hosts holds for the others too, which have too few pages
to be aligned; its lines are at most the inverse of MIN_HOSTS times the lines of one page's template.

Pages are the chunks, joined where they overlap, of documents whose extraction is `fallback`, empty or null. Reference pages
are a bounded number for each host; every page is aligned and every line classified. Pages that repeat a reference
page's sentences are copies and teach nothing. Documents without a readable url share no host template. Null texts have no
lines; equal duplicate rows count once; without start_char, chunks are laid one after another.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.sitelines import site_of
from corpusloom.llm.stream import map_batches
from corpusloom.plans.shared import materialize

REFERENCES, SHARD_PAGES = 8, 1000
MIN_HOSTS, MIN_PAGES, MIN_SHARE, COPY = 0.008, 3, 0.3, 0.3
_DIGITS = re.compile(r"\d+")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\s]*\)")
_LINKS = re.compile(r"(?:\[[^\]\n]*\]\([^)\s]*\)[\s|·•/,-]*){2,}")
_CELLS = re.compile(r"\s+[|·•‧]\s+")
_TRAIL = re.compile(r"(.{1,60}?)\s+[>»›/→]\s+\S")
_BULLET = re.compile(r"^(?:[-*+•»›]|\d+[.)])\s+")
_GENERIC = {"www", "docs", "blog", "wiki", "help", "com", "net", "org", "example"}


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def tokens(line: str, names: set[str]) -> list[str]:
    """The line's label, word by word: lower case, digits as 0, the host's own names as a slot."""
    out = []
    for w in line.lower().split():
        core = w.strip(".,;:!?()[]«»“”\"'’")
        out.append(_DIGITS.sub("0", w.replace(core, "{}") if core in names else w))
    return out


class Line:
    __slots__ = ("text", "places", "label", "words", "cells", "sentence", "block", "index")

    def __init__(self, text: str, names: set[str]):
        self.text, self.places = text.strip(), []
        body = _BULLET.sub("", self.text)
        self.words = tokens(body, names)
        self.label = _hash(" ".join(self.words))
        parts = _LINK.findall(self.text) if _LINKS.fullmatch(self.text) else _CELLS.split(body)
        self.cells = [_hash(" ".join(tokens(p, names))) for p in parts if p.strip()]
        self.sentence = len(self.words) >= 6 and self.text[-1] in ".!?。:…" and len(self.cells) < 3 or self.text.startswith("#")
        self.block = self.index = 0


def page(parts: list[dict], host: str | None) -> list[list[Line]]:
    """The page's blocks of lines; each line knows all its places (chunk_id, line_no)."""
    names = {p for p in (host or "").split(".") if p not in _GENERIC}
    at: dict[int, str] = {}
    places: dict[int, list[tuple[int, int]]] = {}
    end = 0
    parts = sorted(parts, key=lambda p: (p["seq"] if p["seq"] is not None else -1, p["chunk_id"]))
    for p in parts:
        pos = start = p["start_char"] if p["start_char"] is not None else end
        for n, text in enumerate(p["text"].split("\n")):
            # a line cut by the chunk's edge stands inside a whole one
            if pos not in at or len(at[pos]) < len(text):
                at[pos] = text
            places.setdefault(pos, []).append((p["chunk_id"], n))
            pos += len(text) + 1
        end = max(end, start + len(p["text"]) + 1)
    blocks: list[list[Line]] = [[]]
    upto = -1
    for pos in sorted(at):
        if at[pos].strip():
            line = Line(at[pos], names)
            line.places = places[pos]
            if pos < upto:  # the rest of a line that an earlier chunk has whole
                if blocks[-1]:
                    blocks[-1][-1].places.extend(p for p in line.places if p[0] not in {q[0] for q in blocks[-1][-1].places})
                continue
            blocks[-1].append(line)
            upto = pos + len(at[pos])
        elif blocks[-1] and pos >= upto:
            blocks.append([])
    if not blocks[-1]:
        blocks.pop()
    for b, block in enumerate(blocks):
        for i, line in enumerate(block):
            line.block, line.index = b, i
    return blocks


def simple_tree_match(a: list[list[int]], b: list[list[int]]) -> set[tuple[int, int]]:
    """Nodes (block, line) of a that an order-keeping match of the two trees pairs with equal nodes of b."""
    common = {x for block in a for x in block} & {x for block in b for x in block}
    left = [(i, [(j, x) for j, x in enumerate(block) if x in common]) for i, block in enumerate(a)]
    right = [[x for x in block if x in common] for block in b]
    left, right = [x for x in left if x[1]], [x for x in right if x]

    def lines(x: list[tuple[int, int]], y: list[int]) -> list[int]:
        w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + (x[i][1] == y[j]))
        out, i, j = [], len(x), len(y)
        while i and j:
            if x[i - 1][1] == y[j - 1] and w[i][j] == w[i - 1][j - 1] + 1:
                out.append(x[i - 1][0])
                i, j = i - 1, j - 1
            elif w[i][j] == w[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    inner = [[lines(x, y) if set(y) & {v for _, v in x} else [] for y in right] for _, x in left]
    w = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left)):
        for j in range(len(right)):
            w[i + 1][j + 1] = max(w[i][j + 1], w[i + 1][j], w[i][j] + len(inner[i][j]))
    out: set[tuple[int, int]] = set()
    i, j = len(left), len(right)
    while i and j:
        if inner[i - 1][j - 1] and w[i][j] == w[i - 1][j - 1] + len(inner[i - 1][j - 1]):
            out |= {(left[i - 1][0], k) for k in inner[i - 1][j - 1]}
            i, j = i - 1, j - 1
        elif w[i][j] == w[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def _box(block: list[Line]) -> bool:
    """A head and short entries: no sentences before what may be the page's end."""
    head = block[0]
    return len(block) > 1 and not head.sentence and len(head.words) <= 6 and len(head.cells) == 1 and not _BULLET.match(head.text) and not block[1].sentence and "0" not in " ".join(head.words)


def learned(blocks: list[list[Line]], references: list[list[list[int]]], said: list[list[int]]) -> set[tuple[int, str]]:
    """(label, kind) of the page's template nodes: lines, cells, and heads of boxes."""
    tree = [[x.label for x in block] for block in blocks]
    own = {x.label for block in blocks for x in block if x.sentence and len(x.words) >= 8}
    same: set[tuple[int, int]] = set()
    for ref, theirs in zip(references, said):
        if len(own & set(theirs)) <= COPY * len(own) and tree != ref:
            same |= simple_tree_match(tree, ref)
    out: set[tuple[int, str]] = set()

    def learn(x: Line) -> None:
        out.add((x.label, "line"))
        if len(x.cells) > 1 or len(x.words) <= 3:
            out.update((c, "cell") for c in x.cells)

    for walk in (blocks[0], blocks[-1][::-1]):
        for x in walk:
            if (x.block, x.index) not in same or x.text.startswith(("#", "```")):
                break
            learn(x)
    for block in blocks:
        if _box(block) and (block[0].block, 0) in same:
            out.add((block[0].label, "head"))
    return out


def classify(blocks: list[list[Line]], lines: set[int], cells: set[int], heads: set[int]) -> list[Line]:
    """The page's furniture."""
    out: list[Line] = []

    def fits(x: Line) -> bool:
        if x.text.startswith(("#", "```")):
            return False
        if x.label in lines:
            return True
        if len(x.words) <= 24:  # one word may be another host's name
            for i, w in enumerate(x.words):
                core = w.strip(".,;:!?()[]«»“”\"'’")
                if core and _hash(" ".join([*x.words[:i], w.replace(core, "{}"), *x.words[i + 1 :]])) in lines:
                    return True
        return len(x.cells) > 1 and all(c in cells for c in x.cells)

    for block in blocks:
        edge = block is blocks[0] or block is blocks[-1]
        known = [fits(x) or (edge and len(x.cells) == 1 and x.cells[0] in cells and len(x.words) <= 3) for x in block]
        if block is blocks[0]:
            for i, x in enumerate(block):
                m = _TRAIL.match(x.text)
                if not known[i] and i and known[i - 1] and m and not x.sentence and _hash(" ".join(tokens(m[1], set()))) in cells:
                    known[i] = True
        open_box = False
        for i, x in enumerate(block):
            if x.label in heads and i + 1 < len(block) and not block[i + 1].sentence:
                open_box = True
                known[i] = True
            elif known[i]:
                open_box = False
            elif open_box and not x.sentence:
                known[i] = True
            else:
                open_box = False
        if not edge and not (block[0].label in heads) and not all(known):
            continue  # an article's block that happens to hold such a line
        out += [x for x, k in zip(block, known) if k]
    return out


class Furniture:
    def __init__(self, chunks: DataFrame, docs: DataFrame, references: int = REFERENCES, min_hosts: float = MIN_HOSTS):
        plain = F.coalesce(F.lower(F.trim("extraction")), F.lit("")).isin("fallback", "")
        of_doc = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(site_of("url")).alias("host"), F.max(plain).alias("plain")).where("plain").select("doc_id", "host")
        texts = chunks.where("text IS NOT NULL").select("doc_id", "chunk_id", "seq", F.col("start_char").cast("long").alias("start_char"), "text")
        parts = F.collect_set(F.struct("seq", "chunk_id", "start_char", "text")).alias("parts")
        # one page's chunks are bounded by the page
        pages = texts.join(of_doc, "doc_id").groupBy("doc_id", "host").agg(parts)
        self.pages = materialize(pages, "pages")
        self._learn(references, min_hosts)

    def _learn(self, references: int, min_hosts: float) -> None:
        def trees(b: pa.RecordBatch) -> dict:
            tree, said = [], []
            for parts, host in zip(b["parts"].to_pylist(), b["host"].to_pylist()):
                blocks = page(parts, host)
                tree.append([[x.label for x in block] for block in blocks])
                said.append([x.label for block in blocks for x in block if x.sentence and len(x.words) >= 8])
            return {"doc_id": b["doc_id"], "host": b["host"], "tree": tree, "said": said}

        hosted = self.pages.where("host IS NOT NULL")
        some = Window.partitionBy("host").orderBy(F.xxhash64("doc_id"), "doc_id")
        chosen = hosted.select("host", "doc_id").withColumn("n", F.row_number().over(some)).where(F.col("n") <= references).select("doc_id")
        refs = map_batches(hosted.join(chosen, "doc_id").select("doc_id", "host", "parts"), trees, "doc_id long, host string, tree array<array<long>>, said array<long>")
        refs = refs.groupBy("host").agg(F.collect_list(F.struct("doc_id", "tree", "said")).alias("refs"))
        sizes = hosted.groupBy("host").agg(F.count("*").alias("pages")).withColumn("shards", F.ceil(F.col("pages") / SHARD_PAGES).cast("int")).where("pages > 1")
        refs = refs.join(sizes, "host").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        placed = hosted.join(sizes.select("host", "shards"), "host").withColumn("shard", F.pmod(F.xxhash64("doc_id"), "shards").cast("int")).drop("shards")
        both = placed.join(refs.select("host", "shard", "refs"), ["host", "shard"])

        def match(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"host": [], "label": [], "kind": []}
            for doc, host, parts, known in zip(b["doc_id"].to_pylist(), b["host"].to_pylist(), b["parts"].to_pylist(), b["refs"].to_pylist()):
                blocks = page(parts, host)
                others = [r for r in known if r["doc_id"] != doc]
                if blocks and others:
                    for label, kind in learned(blocks, [r["tree"] for r in others], [r["said"] for r in others]):
                        for name, v in zip(out, (host, label, kind)):
                            out[name].append(v)
            return out

        nodes = map_batches(both.select("doc_id", "host", "parts", "refs"), match, "host string, label long, kind string")
        constant = materialize(nodes.groupBy("host", "label", "kind").agg(F.count("*").alias("n")), "constant")
        hosts = F.countDistinct("host")
        total = constant.agg(hosts.alias("hosts")).first()["hosts"]
        # a line that a share of all hosts has: no more of them than 1/share times a page's template
        least = max(3, min_hosts * total)
        shared = constant.groupBy("label", "kind").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= least).select("label", "kind").collect()
        self.shared = self.pages.sparkSession.sparkContext.broadcast({k: {r.label for r in shared if r.kind == k} for k in ("line", "cell", "head")})
        own = constant.join(sizes, "host").where((F.col("n") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("pages")) & (F.col("pages") > 2 * MIN_PAGES))
        own = own.groupBy("host", "shards").agg(F.collect_list(F.struct("label", "kind")).alias("own"))
        self.own = own.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
        self.sizes = sizes

    def found(self) -> DataFrame:
        """(chunk_id, line_no) of every line of furniture."""
        shared = self.shared

        def fn(b: pa.RecordBatch) -> dict:
            chunk, line = [], []
            for host, parts, own in zip(b["host"].to_pylist(), b["parts"].to_pylist(), b["own"].to_pylist()):
                blocks = page(parts, host)
                if not blocks:
                    continue
                sets = [shared.value[k] | {x["label"] for x in own or () if x["kind"] == k} for k in ("line", "cell", "head")]
                for x in classify(blocks, *sets):
                    chunk += [c for c, _ in x.places]
                    line += [n for _, n in x.places]
            return {"chunk_id": chunk, "line_no": line}

        placed = self.pages.join(self.sizes.select("host", "shards"), "host", "left").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("shards", F.lit(1))).cast("int"))
        rows = placed.join(self.own, ["host", "shard"], "left").select("host", "parts", "own")
        return map_batches(rows, fn, "chunk_id long, line_no int").distinct()

    def clean(self) -> DataFrame:
        """(doc_id, chunk_id, text): the chunks of these pages with the article's lines only."""
        lines = self.found().groupBy("chunk_id").agg(F.collect_set("line_no").alias("lines"))
        texts = self.pages.select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.chunk_id", "p.text").join(lines, "chunk_id", "left")
        kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
        return texts.select("doc_id", "chunk_id", F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"))

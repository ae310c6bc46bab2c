"""The operators against plain versions over the small test tables, and invariants."""

import os
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import catalog, furniture, history, kernel, leaks, lookalike, mixing, neighbours, pieces, residue, sitelines, spans

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")


def rows(df):
    return {tuple(r) for r in df.collect()}


def read(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/{name}.parquet").distinct().collect()]


@needs_data
def test_p1(spark):
    sites = {d["doc_id"]: re.sub(r"^www\.", "", re.match(r"\w+://([^/:?#]+)", d["url"])[1].lower()) for d in read(spark, "docs")}
    total, have = defaultdict(set), defaultdict(set)
    for d, s in sites.items():
        total[s].add(d)
    lines = [(sites.get(c["doc_id"]), c["doc_id"], c["chunk_id"], i, sitelines.normal(x)) for c in read(spark, "chunks") for i, x in enumerate(c["text"].split("\n"))]
    for s, d, _, _, x in lines:
        have[s, x].add(d)
    want = {(c, i) for s, _, c, i, x in lines if s and len(x) >= 15 and len(have[s, x]) >= 4 and len(have[s, x]) >= 0.1 * len(total[s])}
    assert rows(catalog.p1_found(spark, DATA)) == want
    # any number of shards gives the same
    few = sitelines.SiteLines(spark.read.parquet(f"{DATA}/chunks.parquet"), spark.read.parquet(f"{DATA}/docs.parquet"), shard_docs=3)
    assert rows(few.found()) == want


@given(st.lists(st.integers(-1, 3), max_size=24))
@settings(max_examples=150, deadline=None)
def test_suffix_array(symbols):
    s = np.array(symbols, np.int64)
    order, lcp = sitelines.suffix_array(s)
    assert sorted(order.tolist()) == list(range(len(s)))

    def common(a, b):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n] >= 0:
            n += 1
        return n

    assert [common(order[i - 1], order[i]) if i else 0 for i in range(len(s))] == lcp.tolist()


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=6), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_repeated_blocks(texts):
    flat, docs = [], []
    for d, t in enumerate(texts):
        flat += [*t, -1]
        docs += [d] * (len(t) + 1)
    seq = np.array(flat, np.int64)
    for at, size, n in sitelines.repeated_blocks(seq, np.array(docs), 2):
        block = flat[at : at + size]
        assert -1 not in block
        assert n == sum(any(t[i : i + size] == block for i in range(len(t))) for t in texts)


@needs_data
def test_p2(spark):
    texts = defaultdict(list)
    for c in sorted(read(spark, "chunks"), key=lambda c: c["seq"]):
        texts[c["doc_id"]].append(c["text"])
    runs = {}
    for d, t in texts.items():
        w = leaks.word_list("\n".join(t))
        if len(w) >= 40:
            runs[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    kept, want = [], {}
    docs = {d["doc_id"]: d for d in read(spark, "docs")}
    for b in sorted({d["batch_id"] for d in docs.values()}):
        new = []
        for i, d in sorted(docs.items()):
            if d["batch_id"] != b:
                continue
            same = {
                k
                for k in kept
                if (d["sha256"] and (docs[k]["sha256"] or "").lower() == d["sha256"].lower())
                or history.page_key(d["url"]) == history.page_key(docs[k]["url"])
                or (i in runs and k in runs and len(runs[i] & runs[k]) >= 0.6 * len(runs[i] | runs[k]))
            }
            if same:
                want[i] = same
            else:
                new.append(i)
        kept += new
    got = {r.doc_id: r.kept for r in catalog.p2_rejected(spark, DATA).collect()}
    assert set(got) == set(want) and all(k in want[d] for d, k in got.items())


def test_p2_hot_cluster(spark):
    """A crowd of near-duplicates, each with its own word, larger than any bucket's direct pairing."""
    words = [f"w{i}" for i in range(120)]
    docs = [(i, 0 if i < 10 else 1 + i % 3, f"https://a.example/{i}", None) for i in range(150)]
    texts = [(i, 0, " ".join(words[:60] + [f"own{i}"] + words[60:])) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, batch_id int, url string, sha256 string")
    c = spark.createDataFrame(texts, "doc_id long, seq int, text string")
    got = {r.doc_id: r.kept for r in history.rejected(d, c).collect()}
    assert set(got) == set(range(10, 150)) and all(k < 10 for k in got.values())


def test_p2_lookup_is_packed(spark):
    """A chunk is no row of its own: the lookup table has a row a slot and batch, however many chunks there are."""
    h = history.History(spark)
    schema = "doc_id long, sha256 string, url string, text string"
    for n in range(2):
        h.add(spark.createDataFrame([(n * 100 + i, None, None, " ".join(f"w{n}x{i}x{j}" for j in range(150))) for i in range(40)], schema))
    assert 0 < h.lookup.read(h.batches).count() <= 2 * h.buckets * 16


@given(st.sets(st.integers(0, 2000), min_size=1, max_size=300), st.sets(st.integers(0, 2000), min_size=1, max_size=40), st.integers(0, 300))
@settings(max_examples=200, deadline=None)
def test_p2_sketches_bound(a, b, shared):
    """Sketches of any sizes never state less than what is in common."""
    b = b | set(sorted(a)[:shared])
    x, y = (kernel.mix(np.array(sorted(v), kernel.U)) for v in (a, b))
    assert len(a & b) <= history.most_common(history.sketch(x), len(a), history.sketch(y), len(b)) <= min(len(a), len(b))


def test_p2_unlike_texts_stay(spark, monkeypatch):
    """Of a text that shares half of its words with many others, in pieces, no other text is read."""
    rng = np.random.default_rng(3)
    pieces = [[f"p{i}x{j}" for j in range(12)] for i in range(40)]
    text = lambda i: " ".join(sum((pieces[k] + [f"own{i}x{k}x{j}" for j in range(12)] for k in rng.permutation(40)[:8]), []))
    schema = "doc_id long, sha256 string, url string, text string"
    h = history.History(spark)
    old = [(i, None, None, text(i)) for i in range(60)]
    h.add(spark.createDataFrame(old, schema))
    compared, made = [], history.materialize
    monkeypatch.setattr(history, "materialize", lambda df, name: (compared.append(name), made(df, name))[1])
    assert h.add(spark.createDataFrame([(100 + i, None, None, text(100 + i)) for i in range(20)], schema)).count() == 0
    assert "verified" not in compared
    assert {r.kept for r in h.add(spark.createDataFrame([(200, None, None, old[7][3] + " more")], schema)).collect()} == {7}
    assert "verified" in compared


def test_p2_edited_texts(spark):
    """Words replaced evenly and at random, down to the bound of overlap, in short and long texts."""
    rng = np.random.default_rng(8)
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    old, new, want = [], [], set()
    for i in range(240):
        n = [40, 60, 99, 101, 160, 319, 321, 700][i % 8]
        w = [f"w{x}" for x in rng.integers(0, 4000, n)]
        at = np.arange(rng.integers(3, 10), n, int(rng.integers(18, 30))) if i % 3 else rng.choice(n, max(1, int(n * rng.uniform(0.02, 0.06))), replace=False)
        v = list(w)
        for x in at:
            v[x] = f"own{i}x{x}"
        if len(runs(w) & runs(v)) >= 0.6 * len(runs(w) | runs(v)):
            want.add(1000 + i)
        old.append((i, None, None, " ".join(w)))
        new.append((1000 + i, None, None, " ".join(v)))
    h = history.History(spark)
    schema = "doc_id long, sha256 string, url string, text string"
    assert h.add(spark.createDataFrame(old, schema)).count() == 0
    got = {r.doc_id: r.kept for r in h.add(spark.createDataFrame(new, schema)).collect()}
    assert len(want) > 150 and set(got) == want and all(k == d - 1000 for d, k in got.items())


def test_p2_history_goes_on(spark, tmp_path):
    """A stored history, opened again, decides a new batch; of its texts only candidates' are compared."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    schema = "doc_id long, sha256 string, url string, text string"
    folder = f"file://{tmp_path}/history"
    one = history.History(spark, folder)
    one.add(spark.createDataFrame([(i, f"S{i}", f"https://a.example/{i}", text(i)) for i in range(50)], schema))
    two = history.History(spark, folder)
    new = [(100, "s3", None, "other"), (101, None, "http://www.a.example/4/", None), (102, None, None, text(5) + " more"), (103, None, None, text(200)), (104, "", "", "")]
    got = {(r.doc_id, r.kept, r.by) for r in two.add(spark.createDataFrame(new, schema)).collect()}
    assert got == {(100, 3, "sha"), (101, 4, "page"), (102, 5, "text")}
    three = history.History(spark, folder)
    assert three.batches == two.batches and {r.doc_id for r in three.add(spark.createDataFrame([(200, None, None, text(200)), (201, None, None, text(6))], schema)).collect()} == {200, 201}
    plan = two.lookup.read(two.batches).join(spark.createDataFrame([(0, 0)], "h long, n int").hint("merge"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("http://www.A.example:80/x/?utm=1&id=2#top", "https://a.example/x?id=2", True),
        ("https://a.example/%7Eu?page=1&lang=en", "http://a.example/~u/?lang=en&page=1", True),
        ("https://a.example/x?id=2", "https://a.example/x?id=3", False),
        ("https://a.example/X", "https://a.example/x", False),
        ("https://a.example:8080/x", "https://a.example/x", False),
    ],
)
def test_page_key(a, b, same):
    assert (history.page_key(a) == history.page_key(b)) == same


@given(st.text(alphabet=st.sampled_from("ab é\n#́。𝒳"), max_size=400), st.integers(4, 60), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_p3_pieces(text, most, overlap):
    parts = pieces.split(text, most, overlap)
    if not text.strip():
        assert parts == []
        return
    start, end = len(text) - len(text.lstrip()), len(text.rstrip())
    assert parts[0][0] == start and parts[-1][1] == end
    assert (len(parts) > 1) == (pieces.measured(text) > most)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d
    assert all(pieces.measured(text[a:b]) <= most for a, b in parts)


@needs_data
def test_p3_found(spark):
    kinds = {d["doc_id"]: (d["doc_type"] or "html").lower() for d in read(spark, "docs")}
    most = {x["doc_type"]: x["max_chars"] for x in read(spark, "split_limits")}
    want = {(c["chunk_id"],) for c in read(spark, "chunks") if len(unicodedata.normalize("NFC", c["text"]).strip()) > most[kinds.get(c["doc_id"], "html")]}
    assert rows(catalog.p3_found(spark, DATA)) == want


@pytest.mark.parametrize(
    "field,value,held",
    [
        ("title", "{{ doc.title }} | Site", True), ("title", "null - Site", True), ("title", "Untitled document", True), ("title", "404 Not Found", True), ("title", "How Site handles 404 answers", False),
        ("title", "Template tags explained: the Site handbook", False), ("title", "Why lorem ipsum ranks for Site", False), ("title", "Lorem ipsum dolor", True), ("title", "JavaScript rendering in Site", False),
        ("warning", "fake-role-line | tool-forgery", False), ("warning", "undefined", True), ("warning", "extract: %%NAME%%", True), ("warning", "", False), ("warning", None, False),
        ("text", "Dear [INSERT NAME], your copy is ready.", True), ("text", "Use `{{ site.email }}` in the header.", False), ("text", "Text\n```\n<p>${name}</p>\n```\nmore", False), ("text", "<p>A ${name}</p>\n```\n\nThe text goes on and on.\nAnd on.\nAnd on.", False),
        ("text", "Please enable JavaScript to view this page.", True), ("text", "Pages that need JavaScript are rendered by the crawler before extraction starts, and then stored with the others.", False), ("text", "asdf asdf asdf asdf", True),
        ("text", "Traceback (most recent call last):", True), ("text", "Une réponse 404 indique que le robot doit oublier l’adresse après 92 essais.", False), ("text", "The token “{{ x }}” is replaced.", False),
    ],
)
def test_p4_labels(field, value, held):
    assert residue.label(field, value)[0] is held


@pytest.mark.parametrize(
    "line,held",
    [
        ("Quisque nunc lectum augue tantor morbi lorem varius glavus sedat nibhum ipsum varius nunc ornate.", True), ("Semper fermis nunc porta ultra dolor semper nunc nibhum varius glavus semper augue dolor.", True),
        ("Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.", True), ("Blah, blah blah! Blah blah.", True),
        ("The shop opens soon. Vestibulum ante ipsum primis in faucibus orci luctus et ultrices.", True), ("Draft layouts of Morugu once held lorem ipsum in every box, which the ranker then indexed.", False),
        ("The sentence “Quisque nunc lorem ipsum varius dolor semper” is filler.", False), ("Write `quisque nunc lorem ipsum varius dolor semper` there.", False), ("El dolor nunca varía, y el ritmo tampoco.", False), ("Quercus robur, Pinus nigra, Acer campestre, Fagus sylvatica", False),
    ],
)
def test_p4_filler_anywhere(line, held):
    assert residue.label("text", "A sentence of the article stands here.\n" + line + "\nAnother one follows it.")[0] is held


def test_p4_spreads_to_near_duplicates(spark):
    body = "Could not connect to the database server at alpha.\n" + "\n".join(f"Could not connect to the database server at beta{i} for reason {i} today." for i in range(30))
    near = "\n".join(f"Cannot reach the store at beta{i} because of some cause {i} now and then, says the log." for i in range(40))
    rows_ = [("text", 1, body), ("text", 2, near), ("text", 3, near + "\nTraceback (most recent call last):"), ("text", 4, "A plain text.")]
    v = spark.createDataFrame(rows_, "field string, row_id long, value string")
    assert {r.row_id for r in residue.Residue(v).found().collect()} == {1, 3}
    copy = "\n".join("Error establishing a database connection." for _ in range(30)) + "\n"
    v = spark.createDataFrame([("text", 1, copy + "one"), ("text", 2, copy.replace("\n", " ; ") + "one"), ("text", 3, "Neither of them.")], "field string, row_id long, value string")
    assert {r.row_id for r in residue.Residue(v).found().collect()} == {1, 2}


def test_p4_links_every_similar_text(spark):
    """Reworded copies of error pages, down to the bound of similarity, and copies of copies, against a plain walk."""
    rng = np.random.default_rng(5)
    base = [[f"{'abcdefgh'[i]}{rng.integers(1000)}" for _ in range(120)] for i in range(6)]
    texts = {}
    for i, words in enumerate(base):
        texts[len(texts)] = "Traceback (most recent call last):\n" * 30 + " ".join(words)
        for edits in (1, 2, 3, 4, 5, 8):
            own = [*("traceback most recent call last " * 30).split(), *words]
            for at in rng.choice(120, edits, replace=False):
                own[150 + at] = f"own{len(texts)}x{at}"
            texts[len(texts)] = " ".join(own)
    sets = {i: set(residue._shingles(kernel.words([t])[0]).tolist()) for i, t in texts.items()}
    want = {i for i, t in texts.items() if residue.label("text", t)[1]}
    assert len(want) == 6
    while new := {b for b in texts if b not in want and any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in want)}:
        want |= new
    assert 12 < len(want) < len(texts)
    v = spark.createDataFrame([("text", i, t) for i, t in texts.items()], "field string, row_id long, value string")
    assert {r.row_id for r in residue.Residue(v).found().collect()} == want


@needs_data
def test_p5(spark):
    vec = defaultdict(dict)
    for v in read(spark, "vectors"):
        if v["vec"] is not None and len(v["vec"]) == v["dim"] and any(v["vec"]):
            vec[v["model"]][v["chunk_id"]] = np.array(v["vec"], float) / np.linalg.norm(v["vec"])
    want = set()
    for by in vec.values():
        ids = sorted(by)
        x = np.array([by[i] for i in ids])
        s = np.round(x @ x.T, 12)
        np.fill_diagonal(s, -2)
        top = {ids[i]: {ids[j] for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9} for i in range(len(ids))}
        want |= {(a, b) for a in ids for b in top[a] if a < b and a in top[b]}
    assert rows(catalog.p5_found(spark, DATA)) == want
    assert catalog.p5_recall(spark, DATA).first().recall >= 0.9


def test_p5_hot_bucket(spark, monkeypatch):
    """Close vectors in large buckets, and copies of one vector."""
    monkeypatch.setattr(neighbours, "BUCKET", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    data = [(i, "m", 16, (base + 0.01 * rng.standard_normal(16)).tolist()) for i in range(120)] + [(1000 + i, "m", 16, base.tolist()) for i in range(40)]
    v = spark.createDataFrame(data, "chunk_id long, model string, dim int, vec array<float>")
    got = neighbours.VectorIndex(v).neighbours().collect()
    assert {r.chunk_id for r in got} == {d[0] for d in data} and all(r.similarity > 0.9 for r in got)
    x = np.array([np.float32(d[3]) for d in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids = [d[0] for d in data]
    best = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:5]}
    found = {(r.chunk_id, r.neighbour) for r in got}
    plain = {p for p in best if p[0] < 1000 and p[1] < 1000}
    assert len(plain & found) >= 0.9 * len(plain)


def _vectors(spark, x):
    return spark.createDataFrame([(i, "m", len(v), v.tolist()) for i, v in enumerate(x)], "chunk_id long, model string, dim int, vec array<float>")


def _nearest(x, k=5):
    x = np.float32(x).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return s, {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


def test_p5_all_neighbours(spark, monkeypatch):
    """Vectors without close neighbours: all k nearest are found all the same, over several blocks."""
    monkeypatch.setattr(neighbours, "GRID", 64, raising=False)
    x = np.random.default_rng(2).standard_normal((400, 32))
    v = _vectors(spark, x)
    got = {(r.chunk_id, r.neighbour) for r in neighbours.VectorIndex(v).neighbours().collect()}
    assert got == _nearest(x)[1]
    r = neighbours.recall(v).first()
    assert (r.true_neighbours, r.found, r.recall) == (100, 100, 1.0)


def test_p5_one_huge_group(spark, monkeypatch):
    """A group so large that all its buckets are: its neighbours are found as in small buckets."""
    for name, value in (("BUCKET", 16), ("BLOCK", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(32) + 0.22 * rng.standard_normal((300, 32))
    s, best = _nearest(x)
    want = {(a, b) for a, b in best if a < b and (b, a) in best and s[a, b] >= 0.9}
    got = rows(neighbours.VectorIndex(_vectors(spark, x)).mutual())
    assert len(want) > 100 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_p5_pairs_of_buckets():
    """Buckets that span batches, large and dense ones: every near pair is met, or its bucket's rows are passed on."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    key = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(neighbours.BUCKET + 50, 50), np.full(60, 51)]))
    code = rng.integers(0, 1 << 62, (len(key), 4)).astype(np.uint64)
    code[key % 7 == 0] = code[0]
    cls = rng.permutation(len(key))
    table = pa.table({"key": key, "cls": cls, "code": [c.tobytes() for c in code]})
    got, passed = set(), set()
    for b in neighbours._met(table.to_batches(max_chunksize=97)):
        for k, a, o in zip(*(b[c].to_pylist() for c in ("key", "a", "b"))):
            passed.add((k, a)) if o is None else got.add((a, o))
    near = {(min(cls[i], cls[j]), max(cls[i], cls[j]), key[i]) for i in range(360) for j in range(i) if key[i] == key[j] and np.bitwise_count(code[i] ^ code[j]).sum() <= neighbours.FAR}
    assert near and all((a, b) in got or {(k, a), (k, b)} <= passed for a, b, k in near)
    assert {c for k, c in passed if k == 50} == set(cls[key == 50].tolist())
    assert len([1 for k, _ in passed]) < len(key)


def test_p5_no_broadcast_of_rows(spark):
    """No side that grows with the vectors is broadcast, however small its files are."""
    v = _vectors(spark, np.random.default_rng(7).standard_normal((50, 16)))
    index = neighbours.VectorIndex(v)
    for df in (index.mutual(), index.neighbours(), neighbours.search(v, v)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_p6_without_data():
    """Without the look-alike data there is an error, not forms by the short list alone."""
    with pytest.raises(RuntimeError):
        lookalike.look_alikes(type("Session", (), {"_jvm": None}))


@pytest.mark.parametrize("a,b,same", [("ﬁne", "fine", True), ("ＡＢ　ｃ", "AB c", True), ("é", "é", True), ("a​b", "ab", True), ("раypal", "paypal", True), ("e", "é", False), ("A", "a", False), ("a b", "a  b", False), ("a\nb", "a b", False), ("👩‍💻", "👩💻", False), ("x²", "x2", False), ("a\r\nb", "a\nb", True)])
def test_p6_skeleton(a, b, same):
    assert (lookalike.skeleton(a) == lookalike.skeleton(b)) == same


def test_p6_public_look_alikes(spark, tmp_path):
    """Letters of the public data unify in the query itself; case, accents and ASCII classes stay apart."""
    (tmp_path / "c.txt").write_text("\ufeff# public\n0251 ;\t0061 ;\tMA\t# x\n0406 ;\t006C ;\tMA\n00F8 ;\t006F 0338 ;\tMA\n")
    assert lookalike.look_alikes(spark, f"file://{tmp_path}/c.txt") == {0x251: "a", 0x406: "I"}
    pairs = [("ɑ", "a"), ("ɡ", "g"), ("ı", "i"), ("ⅰ", "i"), ("ⅼ", "l"), ("ⲟ", "o"), ("ꓐ", "B"), ("ᴏ", "o"), ("‐", "-"), ("ꮯ", "ᴄ"), ("І", "I"), ("ο", "о")]
    apart = [("I", "l"), ("rn", "m"), ("ø", "o"), ("œ", "oe"), ("O", "0"), ("Α", "a"), ("ç", "c")]
    v = spark.createDataFrame([("text", 2 * i + j, f"w{i} {x}") for i, p in enumerate(pairs + apart) for j, x in enumerate(p)], "field string, id long, value string")
    assert rows(lookalike.pairs(v)) == {("text", 2 * i, 2 * i + 1) for i in range(len(pairs))}


@needs_data
def test_p6(spark):
    by = defaultdict(set)
    for r in read(spark, "serp_results"):
        for f in ("title", "snippet"):
            if r[f] is not None:
                by[f, lookalike.skeleton(r[f])].add((r["result_id"], r[f]))
    for c in read(spark, "chunks"):
        by["text", lookalike.skeleton(c["text"])].add((c["chunk_id"], c["text"]))
    want = {(f, min(a, b), max(a, b)) for (f, _), g in by.items() for a, x in g for b, y in g if a < b and x != y}
    assert rows(catalog.p6_found(spark, DATA)) == want


def test_p7_template(spark):
    from itertools import count

    n = count()
    word = lambda: "w" + "".join(chr(97 + int(x)) for x in str(next(n)))
    article = lambda: "\n\n".join(f"Sentence {word()} of the article tells of crawling and of words {word()}, and then it ends." for _ in range(4))
    page = lambda i: f"Home | Docs | Help\nHome > Page {i}\n\n{article()}\n\nRelated articles\n- How {i} works 17\n» Why {i} fails 23\n\n{article()}\n\n© 2020 Site{i % 5}. All rights reserved.\nImprint | Privacy"
    docs = [(i, f"https://site{i % 5}.example/{i}", "fallback") for i in range(25)] + [(99, "https://other.example/", "readability")]
    chunks = [(i, i, 0, page(i), 0) for i in range(25)] + [(99, 99, 0, page(99), 0)]
    d, c = spark.createDataFrame(docs, "doc_id long, url string, extraction string"), spark.createDataFrame(chunks, "doc_id long, chunk_id long, seq int, text string, start_char int")
    f = furniture.Furniture(c, d)
    got = defaultdict(set)
    for r in f.found().collect():
        got[r.chunk_id].add(r.line_no)
    want = {0, 1, 11, 12, 13, 23, 24}
    assert dict(got) == dict.fromkeys(range(25), want)
    assert all("Related" not in r.text and "Sentence" in r.text for r in f.clean().collect())


@given(st.lists(st.lists(st.integers(0, 4), max_size=4), max_size=4), st.lists(st.lists(st.integers(0, 4), max_size=4), max_size=4))
@settings(max_examples=100, deadline=None)
def test_tree_match(a, b):
    for i, j in furniture.simple_tree_match(a, b):
        assert any(a[i][j] in block for block in b)
    assert len(furniture.simple_tree_match(a, a)) == sum(map(len, a))


@needs_data
def test_p8(spark):
    items = [(i["item_id"], leaks.word_list(i["text"])) for i in read(spark, "eval_items")]
    runs = defaultdict(set)
    for i, w in items:
        for k in range(len(w) - 12):
            runs[tuple(w[k : k + 13])].add(i)
    want = set()
    for d in read(spark, "documents"):
        w = leaks.word_list(d["text"])
        want |= {(d["doc_id"], i) for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    assert rows(catalog.p8_found(spark, DATA)) == want


@given(st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_words_hash(a, b):
    w, bounds = kernel.words([a, b])
    for t, i in ((a, 0), (b, 1)):
        own = w[bounds[i] : bounds[i + 1]]
        names = leaks.word_list(t)
        assert len(own) == len(names)
        assert [kernel.words([x])[0][0] for x in names] == own.tolist()


@needs_data
def test_p9(spark):
    m = catalog._mixture(spark, DATA)
    size, total = defaultdict(int), 0
    for d in [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]:
        n = mixing.count_tokens(d["text"])
        total += n
        if d["source"]:
            size[d["source"].strip().lower()] += n
    want = {(t["source"],) for t in read(spark, "mix_targets") if t["max_repeats"] * size[t["source"]] < t["target_share"] * total}
    assert rows(m.report().where("short").select("source")) == rows(m.short()) == want
    blocks = m.packed().collect()
    held = defaultdict(int)
    for r in blocks:
        held[r.source] += r.to_token - r.from_token
    assert all(held[t["source"]] == size[t["source"]] for t in read(spark, "mix_targets"))
    slots = m.slots().collect()
    assert len({(r.source, r["pass"], r.idx) for r in slots}) == len(slots)


def test_p9_refused_slots_decide(spark, monkeypatch):
    """Without the mixture's draw no source is found short."""
    docs = spark.createDataFrame([(i, "word " * 3000, "a" if i < 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(docs, targets)
    assert rows(m.short()) == {("a",)} and {r.source: r.refused > 0 for r in m.report().collect()} == {"a": True, "b": False}
    monkeypatch.setattr(m, "drawn", lambda: spark.createDataFrame([], "source string, shard long, drawn long"))
    assert rows(m.short()) == set()


def test_p1_rows_come_from_the_suffix_array(spark, monkeypatch):
    text = "\n".join(["A notice of the site stands here", "and goes on in a second line", "own {}"])
    d = spark.createDataFrame([(i, f"https://a.example/{i}") for i in range(12)], "doc_id long, url string")
    c = spark.createDataFrame([(i, i, 0, text.format(i)) for i in range(12)], "doc_id long, chunk_id long, seq int, text string")
    s = sitelines.SiteLines(c, d)
    assert rows(s.found()) == {(i, n) for i in range(12) for n in (0, 1)}
    assert [(r.lines, r.docs) for r in s.blocks().collect()] == [(2, 12)]


def test_p3_only_long_texts_are_moved(spark):
    c = spark.createDataFrame([(1, 1, 0, "ab " * 20, 0, 0), (1, 2, 1, "a", 0, 0), (1, 1, 0, "cd " * 20, 0, 0)], "doc_id long, chunk_id long, seq int, text string, start_char int, start_byte long")
    d = spark.createDataFrame([(1, "PDF")], "doc_id long, doc_type string")
    limits = spark.createDataFrame([("html", 100, 5), ("pdf", 30, 5)], "doc_type string, max_chars int, overlap_chars int")
    assert {r.text[0] for r in pieces.limited(c, d, limits).collect()} == {"a", "c"}  # two texts of one key are both kept
    assert pieces.split("One two three. Four five six. Seven eight nine. Ten.", 32, 0)[0][1] in (15, 30)


@given(st.integers(1, 500), st.integers(0, 2**60))
@settings(max_examples=100, deadline=None)
def test_permutation(n, key):
    got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got.tolist()) == list(range(n))


@needs_data
def test_p10(spark):
    texts = {d["doc_id"]: d["text"] or "" for d in read(spark, "documents")}
    at = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - 399):
            at[t[i : i + 400]].add(d)
    want = {(a, b) for g in at.values() for a in g for b in g if a < b}
    assert rows(catalog.p10_found(spark, DATA)) == want
    covered = {}
    for d, t in texts.items():
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if len(at[t[i : i + 400]]) > 1:
                mark[i : i + 400] = True
        covered[d] = int(mark.sum())
    assert {r.doc_id: r.shared_chars for r in catalog.p10_shared(spark, DATA).collect()} == covered


def test_p10_hot_prefix(spark, monkeypatch):
    """A prefix that all texts share, with longer spans inside some groups only."""
    monkeypatch.setattr(spans, "GROUP", 8)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    common, longer = word(250), [word(300) for _ in range(5)]
    texts = [(i, word(120) + common + longer[i % 5] + word(90) + " " * 50) for i in range(60)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(spans.SharedSpans(d).pairs())
    assert got == {(a, b) for a, _ in texts for b, _ in texts if a < b and a % 5 == b % 5}

"""SQL for those queries of the training-data operators that SQL can express."""

from __future__ import annotations

_SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_BLANK = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
_NORMAL = rf"regexp_replace(lower(trim(regexp_replace(line, '{_BLANK}', ' ', 'g'))), '\p{{Nd}}+', '0', 'g')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_LINES = f"""s AS (SELECT doc_id, min({_SITE}) AS site FROM docs GROUP BY doc_id), n AS (SELECT site, count(*) AS n FROM s WHERE site <> '' GROUP BY site),
 c AS (SELECT DISTINCT doc_id, chunk_id, text FROM chunks WHERE text IS NOT NULL), l AS (SELECT doc_id, chunk_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM c),
 k AS (SELECT site, doc_id, chunk_id, line_no, {_NORMAL} AS form FROM l JOIN s USING (doc_id)), f AS (SELECT site, form, count(DISTINCT doc_id) AS docs FROM k WHERE length(form) >= 15 GROUP BY ALL),
 g AS (SELECT site, form, docs, n FROM f JOIN n USING (site) WHERE docs >= 4 AND docs >= 0.1 * n)"""


def statements() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_LINES} SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM k JOIN g USING (site, form)",
        "p3_found": f"""WITH k AS (SELECT doc_id, min(lower(coalesce(nullif(doc_type, ''), 'html'))) AS kind FROM docs GROUP BY doc_id)
 SELECT DISTINCT chunk_id FROM chunks LEFT JOIN k USING (doc_id) JOIN split_limits ON doc_type = coalesce(kind, 'html') WHERE length(regexp_replace(nfc_normalize(text), '^{_BLANK}|{_BLANK}$', '', 'g')) > max_chars""",
        "p5_found": """WITH v AS (SELECT DISTINCT chunk_id, model, vec::DOUBLE[] AS x FROM vectors WHERE vec IS NOT NULL AND len(vec) = dim AND list_sum(list_transform(vec, lambda y: abs(y))) > 0),
 p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.x, b.x) AS s FROM v a JOIN v b ON a.model = b.model AND a.chunk_id <> b.chunk_id AND len(a.x) = len(b.x)),
 t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM p WHERE s >= 0.9)
 SELECT x.a AS chunk_id_a, x.b AS chunk_id_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.r <= 5 AND y.r <= 5 AND x.a < x.b""",
        "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items), d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents),
 ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i)),
 dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d))
 SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        # no verdict depends on the tokenizer: characters stand for tokens
        "p9_found": """WITH t AS (SELECT lower(trim(source)) AS source, max(target_share) AS share, max(max_repeats) AS repeats FROM mix_targets GROUP BY 1), n AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS size FROM documents GROUP BY 1),
 w AS (SELECT sum(length(text)) AS size FROM documents) SELECT t.source FROM t LEFT JOIN n USING (source), w WHERE t.repeats * coalesce(n.size, 0) < t.share * w.size""",
        "p10_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
 m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1), s AS (SELECT g.* FROM g JOIN m USING (h)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id""",
    }

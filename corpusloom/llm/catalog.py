"""Queries of the training-data operators, with their SQL where there is one."""

from __future__ import annotations

from corpusloom.llm import history, leaks, lookalike, neighbours, oracle, pieces, residue
from corpusloom.llm.furniture import Furniture
from corpusloom.llm.mixing import Mixture
from corpusloom.llm.sitelines import SiteLines
from corpusloom.llm.spans import SharedSpans
from corpusloom.plans.shared import table


def _site_lines(spark, folder):
    return SiteLines(table(spark, folder, "chunks"), table(spark, folder, "docs"))


def p1_found(spark, folder):
    return _site_lines(spark, folder).found()


def p1_blocks(spark, folder):
    return _site_lines(spark, folder).blocks()


def p1_clean(spark, folder):
    return _site_lines(spark, folder).clean(table(spark, folder, "chunks"))


def p2_rejected(spark, folder):
    return history.rejected(table(spark, folder, "docs"), table(spark, folder, "chunks"))


def p2_found(spark, folder):
    return history.pairs(p2_rejected(spark, folder))


def p2_accepted(spark, folder):
    return history.accepted(table(spark, folder, "docs"), p2_rejected(spark, folder))


def p3_pieces(spark, folder):
    return pieces.pieces(*(table(spark, folder, t) for t in ("chunks", "docs", "split_limits")))


def p3_found(spark, folder):
    return p3_pieces(spark, folder).where("pieces > 1").select("chunk_id").distinct()


def _residue(spark, folder):
    return residue.Residue(residue.values(table(spark, folder, "docs"), table(spark, folder, "chunks")))


def p4_found(spark, folder):
    return _residue(spark, folder).found()


def p4_clean(spark, folder):
    return _residue(spark, folder).clean()


def p5_found(spark, folder):
    return neighbours.VectorIndex(table(spark, folder, "vectors")).mutual()


def p5_neighbours(spark, folder):
    return neighbours.VectorIndex(table(spark, folder, "vectors"), fit=False).neighbours()


def p5_search(spark, folder):
    v = table(spark, folder, "vectors")
    return neighbours.search(v.where("chunk_id % 20 = 0"), v)


def p5_recall(spark, folder):
    return neighbours.recall(table(spark, folder, "vectors"))


def _values(spark, folder):
    return lookalike.values(table(spark, folder, "serp_results"), table(spark, folder, "chunks"))


def p6_found(spark, folder):
    return lookalike.pairs(_values(spark, folder))


def p6_unified(spark, folder):
    return lookalike.unified(_values(spark, folder))


def p7_found(spark, folder):
    return Furniture(table(spark, folder, "chunks"), table(spark, folder, "docs")).found()


def p7_clean(spark, folder):
    return Furniture(table(spark, folder, "chunks"), table(spark, folder, "docs")).clean()


def p8_found(spark, folder):
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_by_item(spark, folder):
    return leaks.by_item(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _mixture(spark, folder):
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark, folder):
    return _mixture(spark, folder).short()


def p9_shares(spark, folder):
    return _mixture(spark, folder).report()


def p9_selection(spark, folder):
    return _mixture(spark, folder).selection()


def p10_found(spark, folder):
    return SharedSpans(table(spark, folder, "documents")).pairs()


def p10_spans(spark, folder):
    return SharedSpans(table(spark, folder, "documents")).class_spans()


def p10_shared(spark, folder):
    d = table(spark, folder, "documents")
    return SharedSpans(d).shared(d)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()

"""Bounded breadth-first traversal of the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.plans.shared import materialize

BUDGET, TOOL_PAGES, MOST = 25, 200, 100_000


def crawl(edges: DataFrame, seed: str, budget: int = BUDGET, same_domain: bool = True, failed: DataFrame | None = None) -> DataFrame:
    """(url, level, n): pages in the order in which a queue from the seed meets them, at most `budget` that don't fail.

    A page's links are taken in sorted order without fragments; pages of other registrable domains are left out;
    failed pages (url) are met, have no children and are free. The frontier is bounded by the budget, the edges are scanned
    once a level. A budget is at most MOST."""
    if not 0 < budget <= MOST:
        raise ValueError(f"the budget must be 1 to {MOST}")
    spark = edges.sparkSession
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", urls.without_fragment(F.col("dst")).alias("url")).distinct()
    bad = (failed.select("url").distinct() if failed is not None else spark.createDataFrame([], "url string")).withColumn("failed", F.lit(True))
    home = urls.registrable(urls.host(F.lit(seed)))
    seen = spark.createDataFrame([(seed, 0, 1)], "url string, level int, n long").join(bad, "url", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    front, level = seen, 0
    while True:
        met = seen.agg(F.count("*").alias("n"), F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("good")).first()
        if met.good >= budget:
            break
        level += 1
        found = F.broadcast(front.where("NOT failed").select(F.col("url").alias("src"), F.col("n").alias("parent"))).join(e, "src")
        if same_domain:
            found = found.where(urls.registrable(urls.host(F.col("url"))) == home)
        new = found.groupBy("url").agg(F.min("parent").alias("parent")).join(F.broadcast(seen.select("url")), "url", "left_anti")
        new = new.join(bad, "url", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        # of pages that don't fail, only the first that the budget allows can be met, and failing ones before them
        last = new.where("NOT failed").orderBy("parent", "url").limit(budget - met.good).agg(F.max(F.struct("parent", "url")).alias("last"), F.count("*").alias("some")).first()
        if last.some == budget - met.good:
            new = new.where(F.struct("parent", "url") <= F.struct(F.lit(last["last"].parent).alias("parent"), F.lit(last["last"].url).alias("url")))
        order = new.withColumn("_n", F.row_number().over(Window.orderBy("parent", "url")))
        good = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
        kept = order.where("true").withColumn("_before", F.coalesce(good, F.lit(0))).where(F.col("_before") < budget - met.good)
        front = materialize(kept.select("url", F.lit(level).alias("level"), (F.col("_n") + met.n).alias("n"), "failed"), f"level-{level}")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "seen")
    return seen.where("NOT failed").select("url", "level", "n")


def crawl_report(visited: DataFrame, known: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: pages that were new, pages that were known, and pages that failed."""
    k = known.select("url").distinct().withColumn("_k", F.lit(1))
    r = visited.join(k, "url", "left")
    n = failed.select("url").distinct().agg(F.count("*").alias("failed")) if failed is not None else visited.sparkSession.createDataFrame([(0,)], "failed long")
    return r.agg(F.coalesce(F.sum(F.when(F.col("_k").isNull(), 1)), F.lit(0)).alias("fetched"), F.coalesce(F.sum("_k"), F.lit(0)).alias("unchanged")).crossJoin(n)

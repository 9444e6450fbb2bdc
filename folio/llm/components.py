"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import with_facts, written

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _toward(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least of u and its v. It comes from partial minima and is joined back, so a hub is no one's task."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return with_facts(pairs, least, "u").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each id in the links ``a``, ``b`` the least id that it is connected with."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _toward(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a > b").distinct().select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _toward(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.where("a > b").distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    tops = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return tops.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

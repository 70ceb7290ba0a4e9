"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.common import saved


def components(links: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``links`` (columns a, b of one type): nodes share a label if links join them.

    In each round a node moves to the smallest neighbour of its smallest neighbour, links follow their ends, and links
    within one node go. Node names are digests, so their order is random and a round removes a constant share of the
    nodes of any graph, long chains included. Neighbour minima combine on the map side, and links meet them in equi-joins
    that adaptive execution can split, so a hub of any degree is fine. Every round is a written table.
    """
    edges = saved(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    for turn in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        least = saved(least, f"{name}-least-{turn}")
        again = least.select(F.col("node").alias("to"), F.col("to").alias("then"))
        moves = saved(least.join(again, "to", "left").select("node", F.coalesce("then", "to").alias("label")), f"{name}-moves-{turn}")
        if labels is None:
            labels = moves
        else:
            later = moves.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(later, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = saved(labels, f"{name}-labels-{turn}") if turn else labels
        ends = edges
        for end in ("a", "b"):
            to = moves.select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))
            ends = ends.join(to, end)
        ends = ends.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = saved(ends.distinct(), f"{name}-links-{turn}")
    else:
        if not edges.isEmpty():
            raise RuntimeError("components didn't settle")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

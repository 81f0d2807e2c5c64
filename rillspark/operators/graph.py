"""Edge tables: degrees, multiplicities, scores over hops, paths, components, communities, subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.operators.ranking import top_of_each
from rillspark.session import removed, tables_so_far, written


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges at each node, parallel ones counted; summed before the shuffle."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def multiplicities(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.count("*").alias("weight"))


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, to, weight: distinct neighbours in both directions with the number of edges between, written once."""
    one = edges.groupBy(F.col(a).alias("node"), F.col(b).alias("to")).agg(F.count("*").alias("weight")).where("node != to")
    both = one.unionByName(one.select(F.col("to").alias("node"), F.col("node").alias("to"), "weight"))
    return written(both.groupBy("node", "to").agg(F.sum("weight").alias("weight")), "neighbours")


def _step(frontier: DataFrame, near: DataFrame, decay: float) -> DataFrame:
    """node, score of the nodes next to the frontier: the best of ``decay / (1 + ln(1 + degree))`` of the node that is left."""
    out = near.join(frontier, "node")
    # the degree is counted for nodes of the frontier alone
    return out.join(out.groupBy("node").agg(F.count("*").alias("k")), "node").groupBy(F.col("to").alias("node")).agg(F.max(F.col("score") * decay / (1 + F.log1p("k"))).alias("score"))


def two_hop(edges: DataFrame, a: str, b: str, seeds: DataFrame, decay: float) -> DataFrame:
    """Best scores of nodes within two edges of the seeds (columns node, score).

    Each step keeps the best score of a node, so the frontier holds nodes, never paths.
    """
    near = neighbours(edges, a, b)
    one = _step(seeds, near, decay)
    two = _step(one, near, decay)
    return seeds.union(one).union(two).groupBy("node").agg(F.max("score").alias("score"))


def spread_labels(edges: DataFrame, a: str, b: str, most_rounds: int = 200) -> DataFrame:
    """node, label: the smallest node that each node can reach, by rounds until nothing changes.

    A round takes the smallest label around each node and then the label of that label, which halves
    long chains.  Each round is written, so a lost executor costs one round at most.
    """
    mark = tables_so_far()
    near = neighbours(edges, a, b).select("node", "to")
    labels = written(near.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    for _ in range(most_rounds):
        seen = near.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node").agg(F.min("label").alias("seen"))
        low = labels.join(seen, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old"))
        jump = low.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        now = written(jump.select("node", F.least("label", "further").alias("label"), "old"), "labels")
        if now.where("label != old").isEmpty():
            removed(edges.sparkSession, mark, keep=[now])
            return now.select("node", "label")
        labels = now.select("node", "label")
    raise RuntimeError("labels did not settle")


def paths(near: DataFrame, seeds: DataFrame, decay: float, floor: float, depth: int = 3) -> DataFrame:
    """All simple paths of up to ``depth`` edges from the seeds (node, score) whose score stays at or above ``floor``.

    node, score, path: the score falls by ``decay / (1 + ln(1 + degree))`` of each node that is left; the floor
    bounds the frontier, as scores only fall.
    """
    degree = near.groupBy("node").agg(F.count("*").alias("k"))
    frontier = seeds.select("node", "score", F.array("node").alias("path"))
    found = frontier
    for _ in range(depth):
        out = frontier.join(degree, "node").withColumn("score", F.col("score") * decay / (1 + F.log1p("k"))).where(F.col("score") >= floor)
        step = out.join(near.select("node", "to"), "node").where(~F.array_contains("path", F.col("to")))
        frontier = written(step.select(F.col("to").alias("node"), "score", F.concat("path", F.array("to")).alias("path")), "paths")
        found = found.unionByName(frontier)
    return found.where(F.size("path") > 1)


def undominated(found: DataFrame) -> DataFrame:
    """Paths of which no other path from the same seed holds all nodes with at least their score; of equal node sets the best, then the smallest.

    Only paths that share their rarest pair of neighbours are compared: a path that holds another one
    holds all of its nodes.
    """
    signed = found.withColumn("nodes", F.array_sort("path"))
    once = signed.groupBy(F.col("path")[0].alias("seed"), "nodes").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("b")).select("seed", "nodes", (-F.col("b.s")).alias("score"), F.col("b.path").alias("path"))
    big = once.select(F.col("seed").alias("s2"), F.col("nodes").alias("more"), F.col("score").alias("score2"), F.explode("nodes").alias("last"))
    small = once.withColumn("last", F.element_at("path", -1))
    beaten = small.join(big, (F.col("seed") == F.col("s2")) & (small["last"] == big["last"]) & (F.size("nodes") < F.size("more")) & (F.col("score2") >= F.col("score")) & (F.size(F.array_except("nodes", "more")) == 0), "left_anti")
    return beaten.select("seed", "path", "score")


def community_edges(near: DataFrame, labels: DataFrame, most: int = 25) -> DataFrame:
    """label, u, v, rank: the edges inside each community by the degree of both ends, the first ``most``."""
    degree = near.groupBy("node").agg(F.count("*").alias("k"))
    named = labels.join(degree, "node").select("node", "label", "k")
    inside = near.where("node < to").join(named, "node").join(named.select(F.col("node").alias("to"), F.col("label").alias("label2"), F.col("k").alias("k2")), "to").where("label = label2")
    return top_of_each(inside.select("label", F.col("node").alias("u"), F.col("to").alias("v"), (F.col("k") + F.col("k2")).alias("weight")), ["label"], [F.desc("weight"), F.col("u"), F.col("v")], most)


def subgraph(near: DataFrame, keys: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (the keys, and by degree as many of their neighbours as the budget leaves) and edges (with inside: both ends chosen).

    ``budget`` is a small number: the chosen nodes are a bounded table.
    """
    degree = near.groupBy("node").agg(F.count("*").alias("k"))
    cited = keys.select("node").distinct().withColumn("tier", F.lit(0))
    around = near.join(cited.select("node"), "node").select(F.col("to").alias("node")).distinct().join(cited, "node", "left_anti").withColumn("tier", F.lit(1))
    chosen = cited.unionByName(around).join(degree, "node").orderBy("tier", F.desc("k"), "node").limit(budget)
    ends = near.where("node < to").join(F.broadcast(chosen.select("node", F.lit(1).alias("x"))), "node", "left").join(F.broadcast(chosen.select(F.col("node").alias("to"), F.lit(1).alias("y"))), "to", "left")
    return chosen, ends.where("x = 1 or y = 1").select(F.col("node").alias("u"), F.col("to").alias("v"), (F.coalesce(F.col("x") + F.col("y"), F.lit(0)) == 2).alias("inside"))


def weighted_labels(near: DataFrame, rounds: int) -> DataFrame:
    """node, label after so many rounds in which each node takes the label with the most weight around it (the smallest of equals).

    Labels start as the nodes and all change at once, so a given number of rounds has one result.  Edges are summed
    by label before the choice: a hub costs what it has labels around it.
    """
    labels = near.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("to"), "label"), "to").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        # of equal weights the smallest label
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b"))
        labels = written(best.select("node", F.col("b.label").alias("label")), "labels")
    return labels


def expanded(near: DataFrame, seeds: DataFrame, decay: float, floor: float, depth: int = 3, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, score) of what the seeds reach, and (node, score) with the best score of every node reached.

    ``near``: node, to, weight (edges between the two) and, for the order of a budget, lexical.  ``seeds``: node, score.
    An edge takes ``decay / (1 + ln(1 + weight))`` of the score: parallel edges speak for a hub, not for more evidence.
    A layer goes on from a node only if it reached it with more than any layer before, by its best path (of equal ones the
    smallest), so a layer is no larger than the number of nodes; all edges that leave it above the floor are recorded.
    A node with more than ``budget`` neighbours keeps the seeds among them and then the best by lexical, the smallest first of equals.
    """
    best = written(seeds.groupBy("node").agg(F.max("score").alias("score")), "best")
    frontier = best.withColumn("path", F.array("node"))
    anchored = best.select(F.col("node").alias("to"), F.lit(1).alias("anchor"))
    found = None
    for _ in range(depth):
        out = near.join(frontier, "node")
        if budget is not None:
            ranked = top_of_each(out.join(anchored, "to", "left"), ["node"], [F.desc_nulls_last("anchor"), F.desc("lexical"), F.col("to")], budget)
            # seeds stay even where they alone exceed the budget
            out = ranked.drop("rank", "anchor").unionByName(out.join(anchored, "to", "left_semi").join(ranked.select("node", "to"), ["node", "to"], "left_anti"))
        score = F.col("score") * decay / (1 + F.log1p("weight"))
        step = out.where(~F.array_contains("path", F.col("to"))).select(F.col("to").alias("node"), score.alias("score"), F.concat("path", F.array("to")).alias("path")).where(F.col("score") >= floor)
        layer = written(step, "layer")
        found = layer if found is None else found.unionByName(layer)
        first = layer.groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("less"), "path")).alias("b")).select("node", (-F.col("b.less")).alias("score"), "b.path")
        better = first.join(best.select("node", F.col("score").alias("known")), "node", "left").where("known is null or score > known")
        frontier = written(better.select("node", "score", "path"), "frontier")
        best = written(best.unionByName(frontier.select("node", "score")).groupBy("node").agg(F.max("score").alias("score")), "best")
    return found.select("path", "score"), best

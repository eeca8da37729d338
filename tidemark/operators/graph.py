"""Graphs as two tables: edges (src, dst, weight, origin), optionally by graph, and their nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

ORIGINS = ("unknown", "learned", "expert")


def upsert_edges(edges: DataFrame, new: DataFrame, order="seq") -> DataFrame:
    """The last edge of each (src, dst) by ``order``; an origin that isn't known is an error."""
    rows = edges.unionByName(new)
    last = rows.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "origin"), order).alias("e"))
    ok = F.assert_true(F.col("origin").isin(*ORIGINS), F.concat(F.lit("unknown origin "), F.coalesce("origin", F.lit("null"))))
    return last.select("src", "dst", "e.weight", "e.origin").where(ok.isNull())


def edges_with_origin(edges: DataFrame, origin: str) -> DataFrame:
    return edges.where(F.col("origin") == origin)


def remove_below(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.abs("weight") >= least)


def reachable_labels(edges: DataFrame, rounds=30) -> DataFrame:
    """(node, component): least node of each weakly connected component, by repeated minima of neighbours' labels.

    Labels jump to their own label each round, so paths halve; a round is checkpointed so that the plan stays small.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"))).distinct()
    both = durable(both)
    labels = durable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.toDF("v", "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
        new = labels.join(near.withColumnRenamed("u", "node"), "node", "left").withColumn("component2", F.least("component", F.coalesce("l", "component")))
        jump = labels.select(F.col("node").alias("component2"), F.col("component").alias("far"))
        new = durable(new.select("node", "component", "component2").join(jump, "component2", "left").select("node", "component", F.least("component2", F.coalesce("far", "component2")).alias("next")))
        changed = new.where("component != next").limit(1).count()
        labels = new.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def largest_subgraph(edges: DataFrame) -> DataFrame:
    """Edges of the component that has most of them; of equals that with the least node."""
    labels = reachable_labels(edges)
    e = edges.join(labels.withColumnRenamed("node", "src"), "src")
    top = e.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "component").limit(1)
    return e.join(F.broadcast(top.select("component")), "component", "left_semi").select(*edges.columns)


def target_subgraph(edges: DataFrame, node) -> DataFrame:
    """Edges of the node's component; an error if there is no such node."""
    labels = reachable_labels(edges)
    if not labels.where(F.col("node") == F.lit(node)).take(1):
        raise KeyError(node)
    own = labels.where(F.col("node") == F.lit(node)).select("component")
    members = labels.join(F.broadcast(own), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(members, "src", "left_semi").select(*edges.columns)


def markov_blanket(edges: DataFrame, nodes: Sequence) -> DataFrame:
    """Induced edges of the nodes, their parents, children, and the children's other parents."""
    ask = F.col("src").isin(list(nodes)), F.col("dst").isin(list(nodes))
    own = edges.where(ask[0] | ask[1]).select(F.explode(F.array("src", "dst")).alias("node"))
    children = edges.where(ask[0]).select("dst").distinct()
    partners = edges.join(children, "dst", "left_semi").select(F.col("src").alias("node"))
    blanket = own.unionByName(partners).distinct()
    out = edges.join(blanket.withColumnRenamed("node", "src"), "src", "left_semi").join(blanket.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return out.select(*edges.columns)


def to_dag(edges: DataFrame, key="window_idx") -> DataFrame:
    """Per graph the least edges by |weight| go until no cycle is left: of equals the least (i, j) first.

    Sorted downwards, an edge is kept as long as all kept with it are acyclic for some cut: the cut is found by bisection, as
    removing more edges never makes a cycle.
    """
    import pandas as pd

    def cyclic(pairs) -> bool:
        out: dict = {}
        degree: dict = {}
        for a, b in pairs:
            out.setdefault(a, []).append(b)
            degree[b] = degree.get(b, 0) + 1
            degree.setdefault(a, 0)
        ready, left = [n for n, k in degree.items() if not k], len(degree)
        while ready:
            left -= 1
            for b in out.get(ready.pop(), ()):
                degree[b] -= 1
                if not degree[b]:
                    ready.append(b)
        return left > 0

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.assign(_w=rows.weight.abs()).sort_values(["_w", "i", "j"], ascending=[False, False, False])
        pairs, low, high = list(zip(order.i, order.j, strict=True)), 0, len(order)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (low, mid - 1) if cyclic(pairs[:mid]) else (mid, high)
        return order.iloc[:low][rows.columns]

    return edges.groupBy(key).applyInPandas(cut, edges.schema)


def recovery(pred: DataFrame, true: DataFrame, eps=0.01) -> DataFrame:
    """Structural Hamming distance, precision, recall and F1 of predicted edges (|weight| > eps) against true ones (weight > 0)."""
    p = pred.where(F.abs("weight") > eps).select("src", "dst", F.lit(1).alias("p"), F.lit(0).alias("t"))
    t = true.where("weight > 0").select("src", "dst", F.lit(0).alias("p"), F.lit(1).alias("t"))
    c = p.unionByName(t).groupBy("src", "dst").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    c = c.agg(F.count_if(F.expr("p = 1 and t = 1")).alias("tp"), F.count_if(F.expr("p = 1 and t = 0")).alias("fp"), F.count_if(F.expr("p = 0 and t = 1")).alias("fn"))
    return scored(c).withColumn("shd", F.col("fp") + F.col("fn"))


def scored(counts: DataFrame) -> DataFrame:
    """tp, fp, fn -> precision, recall, f1; 0 where a denominator is."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def causal_paths(edges: DataFrame, target: int, depth=3, top=5) -> DataFrame:
    """Simple paths of up to ``depth`` edges that end in the target, with the sum of |weight| along them; the best ``top``.

    Joined backwards step by step: each is an equality join with the edges.
    """
    e = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.abs("weight").alias("_w"))
    paths = e.where(F.col("_d") == target).select(F.array("_s", "_d").alias("path"), F.col("_w").alias("score"), F.col("_s").alias("head"))
    paths = paths.where("head != path[1]")
    found = paths
    for _ in range(depth - 1):
        paths = paths.join(e, paths["head"] == e["_d"]).where(~F.array_contains("path", F.col("_s")))
        paths = paths.select(F.concat(F.array("_s"), "path").alias("path"), (F.col("score") + F.col("_w")).alias("score"), F.col("_s").alias("head"))
        found = found.unionByName(paths)
    out = found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "score")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "path"))).where(F.col("rank") <= top)

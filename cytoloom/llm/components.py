"""Connected components of an edge table.

Small graphs, by a check of their size, are joined in one task; larger ones by alternating large-star
and small-star steps over the cluster.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    rest = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(rest).where("a != b").distinct()


#: Edges up to this number are joined in one task.
ONE_TASK_EDGES = 300_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(frames):
        parent: dict = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for f in frames:
            for row in zip(*(f[c].tolist() for c in f.columns)):
                half = len(row) // 2
                a, b = root(row[:half]), root(row[half:])
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [x + root(x) for x in parent]
        yield pd.DataFrame(rows, columns=names).astype(types)

    kind = edges.schema["a"].dataType
    fields = [(f"{s}.{f.name}", f.dataType) for s in "ab" for f in kind] if hasattr(kind, "fields") else [(s, kind) for s in "ab"]
    flat = edges.select(*[F.col(p).alias(f"f{i}") for i, (p, _) in enumerate(fields)])
    names = flat.columns
    types = {n: "int64" if t.simpleString() == "bigint" else object for n, (_, t) in zip(names, fields)}
    out = flat.coalesce(1).mapInPandas(run, flat.schema)
    half = len(names) // 2
    if not hasattr(kind, "fields"):
        return out.select(F.col("f0").alias("node"), F.col("f1").alias("label"))
    side = lambda at: F.struct(*[F.col(f"f{at + i}").alias(f.name) for i, f in enumerate(kind.fields)])
    return out.select(side(0).alias("node"), side(half).alias("label"))


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): the least node of its component.

    Nodes may be of any ordered type, or structs of such; null ends and loops are left out. Each step is
    written out, so lineage stays short; the number of steps grows with the logarithm of the edges. A
    step joins nodes to one row each, so a hub costs a row a neighbour and no pairs of neighbours.
    """
    edges = edges.where("a is not null and b is not null and a != b").select("a", "b")
    if edges.limit(one_task + 1).count() <= one_task:
        return _in_one_task(edges)
    now = stored(edges.distinct(), "cc")
    state = None
    while True:
        now = stored(_small_star(_large_star(now)), "cc")
        # rows and a sum of their hashes: the same for the same set of distinct edges
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b.  node, root for every node of an edge between two different nodes; root is the component's smallest.

    Every round is two groupings and two joins on the edges, whose number never grows; a hub's many edges are split by
    Spark's skew join and its minimum is combined in the tasks.  Rounds are cut by checkpoint() in the cluster's shared folder and are
    about logarithmic in the component's size.  Edges with a null end are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = e.filter(F.col("u") != F.col("v")).distinct().checkpoint()
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            # every edge now leads from a node to its root
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")

"""Whether single edges lie on an island, without knowing the parts of the whole graph.

From every edge asked, what can be reached and what can reach it grow together, a step of links a round.  The edges in both are its
strongly connected part.  A question is decided as soon as that part has ``max_size`` edges, or once one side has come to its end and the
other has nothing new within it: then the part is as large as it can get.  Rows follow the edges asked times what is looked at for each, and a
round's table replaces the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.graph import transitions
from waymark.storage import drop, materialize

#: Rows of a round that one task holds.
TASK_ROWS = 500_000


def island_test(arcs: DataFrame, asked: DataFrame, forbidden: DataFrame | None = None, *, max_size: int = 1024, rounds: int = 100_000) -> DataFrame:
    """Edges asked (edge_id) with ``on_island``: whether fewer than ``max_size`` edges, itself included, are strongly connected with it; null where it has no arc.

    A link leads from an edge to another where an arc of the second follows one of the first; turns that are forbidden give none, and penalties and
    turns behind prefixes play no part.  Repeated and null ids are asked once.
    """
    if forbidden is not None and "penalty" in forbidden.columns:
        forbidden = forbidden.where("penalty is null").drop("penalty")
    asked = asked.select(F.col("edge_id").cast("long").alias("edge_id")).where("edge_id is not null").distinct()
    links = materialize(transitions(arcs, forbidden).select(F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b")).distinct(), "island-links")
    known = asked.join(arcs.select(F.shiftright("arc_id", 1).alias("edge_id")).distinct(), "edge_id", "left_semi")
    yes, no = F.lit(True), F.lit(False)
    state = materialize(known.select(F.col("edge_id").alias("q"), "edge_id", yes.alias("to"), yes.alias("fro"), yes.alias("new_to"), yes.alias("new_fro")), "island-state")
    decided = []
    whole = Window.partitionBy("q")
    least, n_links = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), links.count()
    for _ in range(rounds):
        # Tasks follow the rows, so that none holds more of them in a larger network; a question's rows meet in one for both steps.
        tasks = max(least, (4 * state.count() + n_links) // TASK_ROWS)
        ahead = state.where("new_to").repartition(tasks, "edge_id").join(links.repartition(tasks, "a"), F.col("edge_id") == F.col("a")).select("q", F.col("b").alias("edge_id"), no.alias("had_to"), no.alias("had_fro"), yes.alias("to"), no.alias("fro"))
        back = state.where("new_fro").repartition(tasks, "edge_id").join(links.repartition(tasks, "b"), F.col("edge_id") == F.col("b")).select("q", F.col("a").alias("edge_id"), no.alias("had_to"), no.alias("had_fro"), no.alias("to"), yes.alias("fro"))
        had = state.select("q", "edge_id", F.col("to").alias("had_to"), F.col("fro").alias("had_fro"), "to", "fro")
        grown = had.unionByName(ahead).unionByName(back).repartition(tasks, "q").groupBy("q", "edge_id").agg(*[F.max(c).alias(c) for c in ("had_to", "had_fro", "to", "fro")])
        grown = grown.withColumn("new_to", F.col("to") & ~F.col("had_to")).withColumn("new_fro", F.col("fro") & ~F.col("had_fro"))
        # Once one side has ended, the other matters within it only.
        more_to, more_fro = F.max("new_to").over(whole), F.max("new_fro").over(whole)
        grown = grown.withColumn("more_to", more_to).withColumn("more_fro", more_fro)
        grown = grown.withColumn("new_to", F.col("new_to") & (F.col("more_fro") | F.col("fro"))).withColumn("new_fro", F.col("new_fro") & (F.col("more_to") | F.col("to")))
        grown = grown.withColumn("size", F.sum((F.col("to") & F.col("fro")).cast("long")).over(whole)).withColumn("open", F.max(F.col("new_to") | F.col("new_fro")).over(whole) & (F.col("size") < max_size))
        after = materialize(grown.select("q", "edge_id", "to", "fro", "new_to", "new_fro", "size", "open"), "island-state")
        drop(state)
        done = materialize(after.where("not open and edge_id = q").select(F.col("q").alias("edge_id"), (F.col("size") < max_size).alias("on_island")), "island-done")
        decided.append(done)
        state = after.where("open").drop("size", "open")
        state._waymark_path = after._waymark_path
        if state.isEmpty():
            break
    else:
        raise RuntimeError(f"islands did not settle in {rounds} rounds")
    drop(state)
    drop(links)
    found = decided[0]
    for part in decided[1:]:
        found = found.unionByName(part)
    out = materialize(asked.join(found, "edge_id", "left"), "island-tested")
    for part in decided:
        drop(part)
    return out

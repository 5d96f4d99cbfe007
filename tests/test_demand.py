"""Tiles that a search reads as it meets them."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_engine import random_graph

from waymark.operators import routing
from waymark.operators.demand import ArcTiles, tree_on_demand, write_arc_tiles


def key(df):
    return sorted((r.source, r.arc_id, r.cost) for r in df.collect())


@pytest.mark.parametrize("few", [1000, 1])
def test_tiles_are_read_once_and_when_met(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr("waymark.operators.demand.NAMED_TILES", few)
    _, arcs, turns = random_graph(spark, 21)
    # Vertex 99 lies in a tile without arcs.
    parts = spark.createDataFrame([*((v, v // 2) for v in range(15)), (99, 70)], "vertex_id long, part long")
    write_arc_tiles(arcs, parts, f"{tmp_path}/tiles", turns)
    sources = spark.createDataFrame([(0,), (0,), (3,), (99,), (None,), (999,)], "source long")
    tiles = ArcTiles(spark, f"{tmp_path}/tiles", turns=True)
    want = key(routing.arc_tree(arcs, sources, turns))
    assert key(tree_on_demand(tiles, sources)) == want and len(want) > 50
    asked = [r.part for t in tiles.asked for r in t.collect()]
    assert len(asked) == len(set(asked)) > 4 and len(tiles.asked) > 1
    tiles.close()
    near = ArcTiles(spark, f"{tmp_path}/tiles", turns=True)
    one = spark.createDataFrame([(0,)], "source long")
    cheap = min(r.cost for r in arcs.where("from_v = 0").collect())
    assert key(tree_on_demand(near, one, max_cost=cheap)) == [x for x in want if x[0] == 0 and x[2] <= cheap]
    assert sum(t.count() for t in near.asked) < len(asked)
    near.close()

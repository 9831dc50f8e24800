"""Tables that grow with the input are joined without a broadcast, however small the optimizer takes them for."""

import pytest

from driftgrid.catalog import QUERIES

# Queries whose tables come from explode or from well compressed columns, which the optimizer takes for small.
NAMES = ["grf9_edge_adjacency", "join15_nearest_cell", "src6_read_edge_outcomes", "gen9_disperse_seeds", "join13_barrier_outcome", "spa6_node_to_cell_mean"]


@pytest.mark.parametrize("name", NAMES)
def test_no_table_is_broadcast(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "BroadcastExchange" not in plan

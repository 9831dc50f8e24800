"""Every registered query with a SQL twin agrees with it on the smallest tables."""

import pytest

from driftgrid.catalog import ORACLES, QUERIES
from driftgrid.plans import star
from tests.oracle import both, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    got, want = both(spark, con, name, sf)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6, nan_ok=True) if all(not isinstance(x, (str, tuple, type(None))) for x in g) else g == w


def test_entry_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(ORACLES) == {"grf5_bridge_gaps", "grf15_expand_ranges", "join5_encounter_totals"}


def test_align_or_fail_query_sees_cells_without_forcing(spark, sf, tmp_path):
    star.table(spark, sf, "part").write.parquet(f"{tmp_path}/part.parquet")
    star.table(spark, sf, "lineitem").filter("l_partkey != 7").write.parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(ValueError, match="1 cell.* 7$"):
        QUERIES["join16_align_or_fail"](spark, str(tmp_path))

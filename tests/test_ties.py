"""Ranks of rows that the SQL's ORDER BY leaves tied."""

import pytest

from tideframe.plans import candidates, registry  # noqa: F401


@pytest.mark.parametrize("step", [1, -1])
def test_ranks_do_not_depend_on_row_order(spark, sf, tmp_path, step):
    """Trades come twice, as symbols A and N, alike in all that the SQL orders by."""
    one = spark.read.parquet(f"{sf}/lineitem.parquet").first().asDict()
    rows = [{**one, "l_orderkey": k, "l_linenumber": 1, "l_returnflag": s} for k in range(1, 51) for s in "AN"][::step]
    spark.createDataFrame(rows, spark.read.parquet(f"{sf}/lineitem.parquet").schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["p07_scenario_gate"](spark, str(tmp_path)).where("scenario = 'symbols'")
    assert sorted(r["rank"] for r in got.collect()) == list(range(2, 101, 2))

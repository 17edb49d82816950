from volmesh import registry
from volmesh.sources import adapters as a

SF = "/root/testdata/sf0.001"


def test_trips_take_as_many_tasks_as_their_lines_ask_for(spark, monkeypatch):
    names = ("open_positions", "stop_reentry")
    plain = {n: sorted(registry.QUERIES[n](spark, SF).collect()) for n in names}
    assert a.derived(spark, SF, a.TRIPS).count() and plain["open_positions"] and plain["stop_reentry"]
    monkeypatch.setattr(a, "TASK_LINES", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for n in names:
        got = registry.QUERIES[n](spark, SF)
        plan = got._jdf.queryExecution().toString()
        physical = plan.split("== Physical Plan ==")[1]
        assert physical.count(f", {lines // 500 + 1}), REPARTITION_BY_NUM") == 2  # once for each table: one pass
        assert sorted(got.collect()) == plain[n]

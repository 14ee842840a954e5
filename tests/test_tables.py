from barloom.catalog import tables as t

SMOKE = "/root/testdata/sf0.001"


def test_days_are_made_along_sorted_lines_that_move_once(spark):
    plan = t.actions(spark, SMOKE, t.bars_in_order)._jdf.queryExecution().sparkPlan().toString()
    days = plan[plan.index("SortAggregate"):]
    assert "HashAggregate" not in plan and days.count("SortAggregate") == 2
    physical = t.actions(spark, SMOKE, t.bars_in_order)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1


def test_a_task_gets_no_more_lines_of_a_larger_table(spark, monkeypatch):
    before = t.bars_in_order(spark, SMOKE)
    monkeypatch.setattr(t, "TASK_LINES", 500)
    after = t.bars_in_order(spark, SMOKE)
    assert after.rdd.getNumPartitions() == t.tasks(spark, SMOKE) == -(-t.table(spark, SMOKE, "lineitem").count() // 500)
    assert sorted(before.collect()) == sorted(after.collect())


def test_both_ways_make_the_same_bars(spark):
    assert sorted(t.bars(spark, SMOKE).collect()) == sorted(t.bars_in_order(spark, SMOKE).collect())

import pytest

from scorewright.operators import alignment


@pytest.mark.parametrize("ids", [[str(i * 7 % 1000) for i in range(1000)], ["10", "9", "x", "", "1e3"], ["2.5", "-1", "1e3", "007", "7"], ["only"], []])
def test_ids_ranked_by_ranges(spark, ids):
    rows = spark.createDataFrame([(i, k) for k, i in enumerate(ids + ids)], "id string, k long")

    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    numbers = all(number(i) is not None for i in ids)
    order = sorted(set(ids), key=lambda i: (number(i) if numbers else 0, i))
    got = {(r.id, r.k, r.item_order) for r in alignment.id_order(rows, "id").collect()}
    assert got == {(i, k, order.index(i)) for k, i in enumerate(ids + ids)}


def test_no_window_over_all_ids(spark):
    """Windows over whole tables only see a row for each range."""
    rows = spark.range(5000).withColumnRenamed("id", "item")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    plan = alignment.id_order(rows, "item")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = [line for line in plan.splitlines() if "Window [" in line and "row_number" in line]
    assert whole and all("__range" in line.split("row_number")[1] for line in whole)

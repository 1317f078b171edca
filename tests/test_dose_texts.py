"""A dose text is read once a row, however many fields of its threshold are asked for."""

from pyspark.sql import functions as F

from posora.functions import rules
from posora.plans import safety


def test_each_pattern_is_searched_once(spark):
    rows = spark.createDataFrame([("가 1,500mg", "50", "mg", 3), ("가 90000마이크로그램", "50", "mg", 2), ("가 4정", "1", "정", 5), ("가 100mg 또는 나 50mg", "1", "mg", 1), (None, "1", "mg", 1), ("가 1.50g", None, "mg", 1)], "rule_value string, amount string, unit string, frequency int")
    read = rows.select(rules.dose_threshold(F.col("rule_value")).alias("d")).select("d.value", "d.unit", "d.status")
    checked = safety.dose_check(rows).select("result", "daily")
    for df in (read, checked):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert 3 <= plan.count("regexp_extract") <= 5  # a count is an extraction of all
    assert [tuple(r) for r in read.collect()] == [("1500", "mg", "parsed"), ("90.000", "mg", "parsed"), ("4", "정", "parsed"), (None, None, "not_evaluable"), (None, None, "not_evaluable"), ("1500.00", "mg", "parsed")]
    assert [r.result for r in checked.collect()] == ["within", "exceeded", "exceeded", "not_evaluable", "not_applicable", "not_evaluable"]

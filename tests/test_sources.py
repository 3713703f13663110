"""The data pack, rule declarations and derived tables."""

import pytest
from pyspark.sql import functions as F

from panelworks.operators import rules
from panelworks.sources import pack

HEAD = "loan_id,month_index,reporting_month,current_status,current_balance,note"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


def test_pack(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pack.load_pack(spark, str(tmp_path))
    train = tmp_path / "loan_monthly_performance_train.csv"
    write(train, "loan_id,month_index", "a,1")
    with pytest.raises(ValueError):
        pack.load_pack(spark, str(tmp_path))
    write(train, HEAD, "a,1,2022-01-01,Current,10.5,x", "a,two,2022-13-45,30DPD,none,", "b,,,,,y")
    found = pack.load_pack(spark, f"file://{tmp_path}/")
    assert found.missing == ["loan_monthly_performance_test", "loan_static_attributes", "servicer_updates"] and found.test is None
    rows = [tuple(str(x) if x is not None else None for x in r) for r in found.train.collect()]
    assert rows == [("a", "1", "2022-01-01", "Current", "10.5", "x"), ("a", None, None, "30DPD", None, None), ("b", None, None, None, None, "y")]
    assert [tuple(r) for r in found.summary().collect()] == [("train", 3, 6, 2)]


def test_rules_and_scenarios(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rules": [{"rule_id": "stale_record", "description": "old",\n "severity": "low"}, {"rule_id": "unheard_of"}, {"severity": "high"}]}')
    declared = pack.load_rules(spark, f"{tmp_path}/rules.json")
    assert {tuple(r) for r in declared.collect()} == {("stale_record", "old", "low", None), ("unheard_of", None, None, None)}
    flagged = spark.createDataFrame([(True, False), (True, True)], "stale_record boolean, date_order_valid boolean")
    got = {r["rule_id"]: tuple(r)[1:] for r in rules.rule_catalog(flagged, declared).collect()}
    assert got == {"stale_record": ("low", 1.0, "declared", True, 2, "old"), "unheard_of": ("medium", 2.0, "declared", False, 0, None), "date_order_valid": ("high", 3.0, "local", True, 1, None)}
    write(tmp_path / "s.csv", "scenario_name,rate_shock_bps,default_multiplier,delinquency_multiplier,prepayment_multiplier", "base,0,1.0,1.0,1.0", "bad,150,1.85,,x")
    assert [tuple(r) for r in pack.load_scenarios(spark, f"{tmp_path}/s.csv").collect()] == [("base", 1.0, 1.0, 1.0), ("bad", 1.85, 1.0, 1.0)]


def test_derived_tables_replace_what_is_there(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("extra"))
    for n in (50, 20):
        pack.write_derived(df.limit(n), f"{tmp_path}/out", ["id", "k"], by=["k"])
        back = spark.read.parquet(f"{tmp_path}/out")
        assert set(back.columns) == {"id", "k"} and back.count() == n
    pack.write_derived(df.limit(0), f"{tmp_path}/none", kind="csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/none").count() == 0

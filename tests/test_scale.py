"""How the shared steps read and move rows, on rows of the tests' own."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from factloom.operators import catalog, cube, derived, retrieval
from workloads import views


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue().splitlines()


def depth(line):
    return len(line) - len(line.lstrip(" +-:*()0123456789"))


def shuffles_of(plan, column):
    """Shuffles that rows with this column pass on their way up."""
    found = 0
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line or "Exchange REBALANCE" in line:
            below = []
            for other in plan[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            found += any("Scan" in b and column in b for b in below)
    return found


def star(spark, folder, keys=(1, 2, 3)):
    tables = {
        "region": "values (0, 'ASIA'), (1, null) t(r_regionkey, r_name)",
        "nation": "values (5, 'CHINA', 0), (6, 'PERU', 1) t(n_nationkey, n_name, n_regionkey)",
        "customer": "values (1, 'one', 5, 'AUTO'), (2, 'two', 6, 'AUTO'), (2, 'again', 5, null), (null, 'none', 5, 'X')"
        " t(c_custkey, c_name, c_nationkey, c_mktsegment)",
        "part": "values (7, 'B1', 'T1'), (8, 'B2', null), (8, 'B3', 'T3'), (null, 'B', 'T') t(p_partkey, p_brand, p_type)",
        "orders": "values (1, 1, 'O', date'2020-01-01', 'HIGH'), (2, 2, 'F', null, 'LOW'), (3, null, 'F', null, 'LOW')"
        " t(o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority)",
        "lineitem": "values (1, 7, 1, 5.0D, 10.0D, 0.1D, 0.2D, 'A', 'F', date'2020-01-02'),"
        " (2, 8, 7, 50.0D, 20.0D, 0.0D, 0.2D, 'A', 'F', null), (2, null, 1, 5.0D, 1.0D, 0.0D, 0.0D, 'N', 'O', null),"
        " (null, 7, 1, 5.0D, 1.0D, 0.0D, 0.0D, 'N', 'O', null), (3, 7, 1, 5.0D, 1.0D, 0.0D, 0.0D, 'N', 'O', null)"
        " t(l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,"
        " l_linestatus, l_shipdate)",
    }
    for name, rows in tables.items():
        spark.sql(f"select * from {rows}").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_order_lines_pass_two_shuffles(spark, tmp_path):
    folder = star(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(views.sales(spark, folder))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles_of(plan, "l_extendedprice") == 2


def test_sales_keep_repeated_keys_and_drop_missing_ones(spark, tmp_path):
    rows = views.sales(spark, star(spark, tmp_path)).select("order_id", "customer_name", "brand", "sales_amount")
    found = sorted(map(tuple, rows.collect()), key=str)
    assert found == sorted(
        [(1, "one", "B1", 10.0)]
        + [(2, c, b, None) for c in ("two", "again") for b in ("B2", "B3")],
        key=str,
    )


SEVERAL = """
    id % 3 as whole, case when id % 4 = 0 then double('nan') when id % 4 = 1 then -0.0D else id / 2 end as number,
    cast(id % 5 as decimal(9, 2)) as exact, if(id % 2 = 0, null, repeat('long text ', cast(id % 3 as int) * 10)) as words,
    timestamp_ntz'2020-01-01 00:00:00' as moment, id % 2 = 0 as flag, array(id) as list
"""


def test_stored_columns_are_counted_one_by_one(spark, tmp_path):
    rows = spark.sql(f"select {SEVERAL} from range(50)")
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = plan_of(catalog.value_counts(stored))
    # No row is multiplied by its columns, and a task's keys are those of one column.
    assert not any("Generate" in line for line in plan)
    counted = catalog.value_counts(stored)
    unpivoted = catalog.value_counts(rows)
    assert counted.schema.simpleString() == unpivoted.schema.simpleString()
    assert sorted(map(str, counted.collect())) == sorted(map(str, unpivoted.collect()))


def test_wide_tables_are_read_in_a_bounded_number_of_parts(spark, tmp_path):
    names = [f"c{i}" for i in range(catalog.SCANS + 8)]
    spark.range(9).select(*[(F.col("id") % (i % 4 + 1)).alias(n) for i, n in enumerate(names)]).write.parquet(
        str(tmp_path / "wide")
    )
    stored = spark.read.parquet(str(tmp_path / "wide"))
    counted = catalog.value_counts(stored)
    assert sum("FileScan" in line for line in plan_of(counted)) <= catalog.SCANS
    per_column = {r["ordinal"]: r["values"] for r in counted.groupBy("ordinal").agg(F.count("*").alias("values")).collect()}
    assert per_column == {i: i % 4 + 1 for i in range(len(names))}


def test_rows_past_the_first_key_are_not_ordered(spark, monkeypatch):
    """Rows whose first key comes after the first thousand are left out before the others are put in order."""
    seen = {}
    prefix = derived._from_prefix

    def spied(text, width, leading=None):
        seen["kept"] = text.where(leading).count()
        return prefix(text, width, leading)

    monkeypatch.setattr(derived, "_from_prefix", spied)
    row = "concat('x', id % 3) as a, concat('y', id % 2) as b, concat('x', id % 3, '-', 'y', id % 2) as joined"
    rows = spark.sql(f"select if(id < 10, null, cast(id div 7 as int)) as k, id as line, {row} from range(50000)")
    assert derived.derived_columns(rows, ["k", "line"]) == ["joined"]
    assert 1000 <= seen["kept"] < 1010
    # All first rows without a first key.
    gaps = rows.withColumn("k", F.when(F.col("line") >= 2000, F.col("k")))
    assert derived.derived_columns(gaps, ["k", "line"]) == ["joined"]
    assert seen["kept"] == 2000


def test_questions_are_not_gathered_by_pair_of_columns(spark, tmp_path):
    """All questions about a pair of columns would otherwise be the work of one task."""
    tables = {
        "structured": "select 'q' || id as question_id, 'm' as target_metric, cast(array() as array<string>) as dimensions,"
        " if(id % 2 = 0, map('d', 'V1'), cast(map() as map<string, string>)) as filters from range(6)",
        "stored": "select 'd' as dimension, 'm' as metric, 'f' || id as fact_id, 'v' || id as dimension_value,"
        " false as is_null, double(id) as sum, double(id) as mean, id as count from range(30)",
        "evidence": "select 'd' as column_a, 'm' as column_b, 'cat_num' as rel_type, 0.5D as strength_score,"
        " 7L as relationship_id",
    }
    read = {}
    for name, rows in tables.items():
        spark.sql(rows).write.parquet(f"{tmp_path}/{name}")
        read[name] = spark.read.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.observations(read["structured"], read["stored"], read["evidence"])
        plan = plan_of(found)
        rows = [(r["question_id"], r["position"], r["fact_id"]) for r in found.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for i, line in enumerate(plan):
        if re.search(r"hashpartitioning\(dimension#\d+, metric#\d+, \d+\)", line):
            below = plan[i + 1 :]
            inside = below[: next((k for k, b in enumerate(below) if depth(b) <= depth(line)), len(below))]
            assert not any("Scan" in b and "question_id" in b for b in inside)
    best = [(p + 1, f"f{29 - p}") for p in range(10)]
    assert sorted(rows) == sorted(
        [(f"q{i}", *b) for i in (1, 3, 5) for b in best] + [(f"q{i}", 1, "f1") for i in (0, 2, 4)]
    )


def test_merging_cubes_keeps_numbers_only(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, float("inf"))], "d string, m double")
    two = spark.createDataFrame([("a", 8.0), ("b", None), (None, 2.0)], "d string, m double")
    merged = cube.merged_cubes(cube.cube(one, ["d"], ["m"]), cube.cube(two, ["d"], ["m"]))
    assert not [line for line in plan_of(merged) if "collect_list" in line or "ObjectHashAggregate" in line]
    found = {r["value"]: (r["sum"], r["mean"], r["count"], r["variance"]) for r in merged.collect()}
    assert found["a"] == (12.0, 4.0, 3, 13.0) and found["b"] == (None, None, 0, None)
    assert found[None] == (float("inf"), float("inf"), 2, float("inf"))

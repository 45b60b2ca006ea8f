"""How the queries run: no nested loops, no Python workers, filters in the scan, hot keys split."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from circdesk.model import messages, vocab
from circdesk.operators import (
    admission,
    batches,
    cataloguing,
    checks,
    components,
    in_order,
    lending,
    measures,
    ordering,
    reports,
)
from circdesk.operators.skew import spread_join
from circdesk.plans.oracle import ORACLE
from circdesk.plans.registry import QUERIES
from circdesk.sources.derived import AS_OF, derived_library
from circdesk.sources.library import read_library, write_library
from tests.conftest import SMALL, rows

EAGER = ("p1", "p2", "p3", "p4", "t1_t4_admit")  # these run jobs while they are built


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("library") / "tables")
    write_library(derived_library(spark, SMALL), folder)
    return read_library(spark, folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert not re.search("Python|Pandas|InArrow", plan)


@pytest.mark.parametrize("name", [
    "p1_create_loans", "p2_apply_extensions", "p3_process_returns", "p4_ingest_books", "t1_t4_admit_statements",
    "t5_admit_extensions", "t6_admit_readers",
])
def test_what_batches_write_on_the_way(spark, monkeypatch, name):
    """The plan of every intermediate result that a batch writes, and of its outcome."""
    plans = []
    for module in (admission, batches, cataloguing, components, in_order, lending, ordering):
        write = getattr(module, "durable", None)
        if write is not None:
            monkeypatch.setattr(module, "durable", lambda df, write=write, **k: plans.append(plan_of(df)) or write(df, **k))
    plans.append(plan_of(QUERIES[name](spark, SMALL)))
    assert len(plans) > 1
    for plan in plans:
        assert not re.search("NestedLoop|Cartesian|Python|Pandas|InArrow", plan)


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(measures.stock_open4(stored))
    assert re.search(r"PushedFilters: \[.*In\(trang_thai_muon", plan)
    assert re.search(r"ReadSchema: struct<ma_sach:bigint,trang_thai_muon:string>", plan)
    plan = plan_of(measures.overdue_debt(stored, AS_OF))
    assert "LessThan(ngay_tra_du_kien" in plan and "IsNull(ngay_tra_thuc_te)" in plan
    plan = plan_of(reports.lookup(stored.chi_tiet, ma_phieu_muon=3))
    assert "EqualTo(ma_phieu_muon,3)" in plan
    plan = plan_of(reports.classify_income(stored, "2001-03"))
    assert "GreaterThanOrEqual(ngay_lap" in plan and "LessThan(ngay_lap" in plan


def test_lines_are_counted_before_they_are_shuffled(stored):
    plan = plan_of(reports.stock_report(stored))
    assert plan.index("partial_count") > 0
    tree = plan[: plan.index("\n\n")]
    assert tree.count("Scan parquet") == 2  # books once, lines once


def test_unused_slip_counts_are_not_computed(spark):
    """The number of lines per slip is a join over all lines; readers of other columns skip it."""
    t = derived_library(spark, SMALL)
    plan = plan_of(t.phieu_muon.select("ma_phieu_muon", "ma_the"))
    assert "Join" not in plan


def test_adaptive_execution_splits_a_hot_book(spark, stored, tmp_path):
    """Lines against the book table are a plain shuffle join, so a book with most lines is split."""
    hot = spark.range(200_000).select(
        F.col("id").alias("ma_phieu_muon"),
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 200).alias("ma_sach"),
        F.current_date().cast("timestamp_ntz").alias("ngay_tra_du_kien"),
        F.lit(None).cast("timestamp_ntz").alias("ngay_tra_thuc_te"),
        F.lit(vocab.TRE_HAN).alias("trang_thai_muon"), F.sha2(F.col("id").cast("string"), 256).alias("trang_thai_sach"),
    )
    path = str(tmp_path / "hot")
    hot.repartition(8).write.parquet(path)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = measures.fine_additive(stored.having(chi_tiet=spark.read.parquet(path)), AS_OF)
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("counted", [None, "n"])
def test_spread_join_equals_join(spark, how, counted):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("v"),
    )
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 20").withColumn("w", F.col("k") * 2)
    if counted is None:
        right = right.drop("n")
    spread = spread_join(left, right, ["k"], how, counted=counted, rows_per_task=100)
    plain = left.join(right.drop("n"), ["k"], how)
    columns = ["k", "v"] + (["w"] if how in ("inner", "left") else [])
    assert sorted(spread.columns) == sorted(columns)
    assert rows(spread, *columns) == rows(plain, *columns)


def test_spread_join_cuts_the_hot_key(spark):
    left = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, 5)], "k int, w int")
    plan = plan_of(spread_join(left, right, ["k"], "inner", rows_per_task=100))
    assert "_piece" in plan and "NestedLoop" not in plan


def test_people_check_has_one_equi_join(stored):
    new = stored.doc_gia.withColumn("statement_id", F.col("ma_doc_gia"))
    plan = plan_of(checks.check_unique_reader(stored, new).violations)
    tree = plan[: plan.index("\n\n")]
    assert len(re.findall(r"Join", tree)) == 1


def test_words_are_in_composed_form():
    for name, value in [*vars(vocab).items(), *vars(messages).items()]:
        for word in (value,) if isinstance(value, str) else value if isinstance(value, tuple) else ():
            assert word == unicodedata.normalize("NFC", word), name


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[-1] == "tien_phat" and df.count() > 0


@pytest.mark.parametrize("name", ["p6_lines_after", "t5_check_single_extension_strict", "f3_fine_replacement_sql", "f4_fine_additive_sql"])
def test_lines_needed_several_times_are_derived_once(spark, name):
    assert "lineitem.parquet" not in plan_of(QUERIES[name](spark, SMALL))

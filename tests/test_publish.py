import pytest

from pyspark.sql import functions as F

from circdesk.model import vocab as V
from circdesk.model.schema import columns
from circdesk.model.tables import Tables
from circdesk.operators import checks, measures
from circdesk.operators.checks import restock_on_return
from circdesk.operators.deltas import apply_changes
from circdesk.operators.scratch import durable_by, scratch_folder
from circdesk.sources import versions
from circdesk.sources.library import library_of, rows_of
from circdesk.sources.versions import (
    COMPACTED,
    REPLACED,
    ROWS,
    VALUES,
    AlreadyPublished,
    Changes,
    Update,
    changes_between,
    compact,
    current_release,
    is_published,
    publish,
    read_outcome,
    read_release,
    remove_unused,
    unused_places,
)
from circdesk.streaming.intake import (
    accounts_step,
    cancellations_step,
    decisions_step,
    extensions_step,
    intake,
    loans_step,
    returns_step,
    run_step,
)
from tests.conftest import NOW, day, rows
from tests.test_plans import plan_of

LOAN = "request_id bigint, seq bigint, ma_the bigint, ma_nhan_vien bigint, danh_sach_sach string, so_ngay_muon int"


def small_library(spark):
    return library_of(
        spark,
        sach=[{"ma_sach": 1, "ten_sach": "A", "so_luong": 2}, {"ma_sach": 2, "ten_sach": "B", "so_luong": 1}],
        the_thu_vien=[
            {"ma_the": 1, "ma_doc_gia": 1, "trang_thai": V.HOAT_DONG, "ngay_het_han": day("2002-01-01")}
        ],
        phieu_muon=[{"ma_phieu_muon": 5, "ma_the": 1}],
    )


def everything(tables):
    return {n: getattr(tables, n) for n in tables.names()}


def test_releases(spark, tmp_path):
    base = str(tmp_path / "lib")
    with pytest.raises(FileNotFoundError):
        read_release(spark, base)
    tables = small_library(spark)
    with pytest.raises(ValueError):
        publish(spark, base, {"sach": tables.sach})
    with pytest.raises(ValueError):
        publish(spark, base, {**everything(tables), "kho": tables.sach})
    assert publish(spark, base, everything(tables)) == 1
    first = current_release(spark, base)
    change = spark.createDataFrame([(1, None)], "ma_sach bigint, so_luong int")
    new = apply_changes(read_release(spark, base).sach, change, ["ma_sach"], ["so_luong"])
    assert publish(spark, base, {"sach": new}, source="night") == 2
    second = current_release(spark, base)
    assert {n for n in first.parts if first.parts[n] != second.parts[n]} == {"sach"}
    assert rows(read_release(spark, base).sach, "ma_sach", "so_luong") == [(1, None), (2, 1)]
    assert is_published(spark, base, "night") and not is_published(spark, base, "day")


def test_an_unfinished_release_stays_invisible(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(small_library(spark)))
    broken = rows_of(spark, "sach", [{"ma_sach": 9}]).selectExpr("*").withColumnRenamed("so_luong", "khac")
    with pytest.raises(Exception):
        publish(spark, base, {"hoa_don": rows_of(spark, "hoa_don", [{"ma_hoa_don": 1}]), "sach": broken})
    assert current_release(spark, base).number == 1
    assert read_release(spark, base).hoa_don.count() == 0


def test_loans_and_returns_change_the_release(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(small_library(spark)))
    loans = spark.createDataFrame([(1, 1, 1, 1, "1,2", 14), (2, 2, 1, 1, "2", 14)], LOAN)
    run_step(spark, base, loans_step(NOW, "on_shelf"), loans)
    now = read_release(spark, base)
    assert rows(now.chi_tiet, "ma_phieu_muon", "ma_sach") == [(6, 1), (6, 2)]
    assert rows(now.sach, "ma_sach", "so_luong") == [(1, 1), (2, 0)]
    back = spark.createDataFrame(
        [(1, 1, 6, 2, V.TOT, 1)],
        "request_id bigint, seq bigint, ma_phieu_muon bigint, ma_sach bigint, trang_thai_sach string, ma_nhan_vien bigint",
    )
    run_step(spark, base, returns_step("2001-08-20 00:00:00", "on_shelf"), back)
    later = read_release(spark, base)
    assert rows(later.sach, "ma_sach", "so_luong") == [(1, 1), (2, 1)]
    assert rows(later.hoa_don, "ma_hoa_don", "so_tien", "ma_doc_gia") == [(1, 100000, 1)]
    assert rows(later.chi_tiet, "ma_sach", "trang_thai_muon") == [(1, V.DANG_MUON), (2, V.TRA_TRE)]


def test_a_stream_of_requests_is_applied_once(spark, tmp_path):
    base, arrivals = str(tmp_path / "lib"), str(tmp_path / "in")
    publish(spark, base, everything(small_library(spark)))
    for i, books in enumerate(("2", "1", "2"), start=1):
        spark.createDataFrame([(i, i, 1, 1, books, 14)], LOAN).coalesce(1).write.mode("append").parquet(arrivals)

    def run(checkpoint):
        source = spark.readStream.schema(LOAN).option("maxFilesPerTrigger", 1).parquet(arrivals)
        query = (
            intake(source, base, loans_step(NOW), "loans")
            .option("checkpointLocation", str(tmp_path / checkpoint))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        assert query.exception() is None

    run("a")
    release = read_release(spark, base)
    assert rows(release.chi_tiet, "ma_sach") == [(1,), (2,)]  # the third request found no copy
    assert rows(release.phieu_muon, "ma_phieu_muon") == [(5,), (6,), (7,)]
    assert rows(read_outcome(spark, base), "request_id", "thanh_cong", "ma_phieu_muon") == [(3, False, None)]
    run("a")  # nothing has arrived since
    assert current_release(spark, base).number == 4
    spark.createDataFrame([(4, 4, 1, 1, "1", 14)], LOAN).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in2"))
    arrivals = str(tmp_path / "in2")
    run("b")  # a new checkpoint counts from 0 again, with other data
    assert current_release(spark, base).number == 5
    assert rows(read_release(spark, base).phieu_muon, "ma_phieu_muon") == [(5,), (6,), (7,), (8,)]


def test_every_batch_has_its_own_moment(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(small_library(spark)))
    moments = iter(["2001-08-01 00:00:00", "2001-08-05 00:00:00"])
    step = loans_step(lambda: next(moments))
    for i in (1, 2):
        run_step(spark, base, step, spark.createDataFrame([(i, i, 1, 1, str(i), 14)], LOAN))
    assert rows(read_release(spark, base).phieu_muon, "ma_phieu_muon", "ngay_lap") == [
        (5, None), (6, day("2001-08-01")), (7, day("2001-08-05"))
    ]


LINES = [{"ma_phieu_muon": i, "ma_sach": i % 7, "trang_thai_muon": V.DANG_MUON} for i in range(300)]
STATUS = "ma_phieu_muon bigint, ma_sach bigint, trang_thai_muon string"


def lines_library(spark):
    slips = [{"ma_phieu_muon": i, "ma_the": i % 11} for i in range(1000)]
    return small_library(spark).having(chi_tiet=rows_of(spark, "chi_tiet", LINES), phieu_muon=rows_of(spark, "phieu_muon", slips))


def status_change(spark, *changes):
    return Changes(updated={"chi_tiet": Update(spark.createDataFrame(list(changes), STATUS), ["trang_thai_muon"])})


def files_read(df):
    """Number of files the scans of a finished query opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            metric = node.metrics().get("numFiles")
            found += metric.get().value() if metric.isDefined() else 0
        inner = [node.plan()] if node.nodeName().endswith("QueryStage") else []
        inner += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_appends_and_updates_rewrite_no_file(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    first = current_release(spark, base)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "lib").rglob("*.parquet")}
    publish(spark, base, Changes({"chi_tiet": rows_of(spark, "chi_tiet", [{"ma_phieu_muon": 900, "ma_sach": 1}])}))
    publish(spark, base, status_change(spark, (5, 5, V.DA_TRA)))
    third = current_release(spark, base)
    assert third.parts["chi_tiet"][0] == first.parts["chi_tiet"][0]
    kinds = [(p.kind, p.rows, len(p.buckets), p.hidden) for p in third.parts["chi_tiet"]]
    assert kinds == [(REPLACED, 300, 64, ()), (ROWS, 1, 1, ()), (VALUES, 1, 1, ())]
    assert {p: p.stat().st_mtime_ns for p in files} == files  # as they were
    new = [p for p in (tmp_path / "lib" / "chi_tiet").rglob("*.parquet") if p not in files]
    assert len(new) == 2  # one with the new row, one with the new value
    now = rows(read_release(spark, base).chi_tiet, "ma_phieu_muon", "trang_thai_muon")
    assert now == sorted([(i, V.DA_TRA if i == 5 else V.DANG_MUON) for i in range(300)] + [(900, None)],
                         key=lambda r: r[0])
    assert rows(read_release(spark, base, 2).chi_tiet, "trang_thai_muon")[-1] == (V.DANG_MUON,)


def test_the_last_value_of_a_column_counts(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(small_library(spark)))

    def set_(columns, *values):
        change = spark.createDataFrame(list(values), f"ma_sach bigint, {columns}")
        publish(spark, base, Changes(updated={"sach": Update(change, change.columns[1:])}))

    set_("so_luong int", (1, 7), (2, 8), (99, 1))
    set_("ten_sach string, so_luong int", (1, None, 9))
    set_("ten_sach string", (2, "C"))
    set_("so_luong int", (1, None))
    want = [(1, None, None), (2, "C", 8)]
    assert rows(read_release(spark, base).sach, "ma_sach", "ten_sach", "so_luong") == want
    before = current_release(spark, base)
    assert compact(spark, base, share=10) == before.number  # too few values for that
    assert compact(spark, base) == before.number + 1
    after = current_release(spark, base)
    assert rows(read_release(spark, base).sach, "ma_sach", "ten_sach", "so_luong") == want
    assert [p.kind for p in after.parts["sach"]] == [COMPACTED] and compact(spark, base) == after.number
    set_("so_luong int", (2, 1))
    assert rows(read_release(spark, base).sach, "ma_sach", "ten_sach", "so_luong") == [(1, None, None), (2, "C", 1)]


def test_compaction_leaves_untouched_buckets_alone(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    publish(spark, base, status_change(spark, (5, 5, V.DA_TRA), (6, 6, V.DA_TRA)))
    plain = rows(read_release(spark, base).chi_tiet, *columns("chi_tiet"))
    compact(spark, base)
    parts = current_release(spark, base).parts["chi_tiet"]
    assert [p.kind for p in parts] == [REPLACED, COMPACTED] and 1 <= len(parts[0].hidden) <= 2
    assert sorted(parts[0].hidden) == sorted(parts[1].buckets)
    assert rows(read_release(spark, base).chi_tiet, *columns("chi_tiet")) == plain


def test_rows_are_dealt_without_their_bucket(spark, tmp_path, monkeypatch):
    """The bucket, one more column of every shuffled row, is added after the shuffle."""
    dealt = []
    monkeypatch.setattr(versions, "_lay", lambda r, name, lay=versions._lay: dealt.append(lay(r, name)) or dealt[-1])
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    assert [d.columns for d in dealt] == [columns(n) for n in Tables.names()]
    assert all("REPARTITION_BY_COL" in plan_of(d) for d in dealt)
    assert rows(read_release(spark, base).chi_tiet, *columns("chi_tiet")) == rows(lines_library(spark).chi_tiet, *columns("chi_tiet"))


def test_a_feed_opens_only_touched_buckets(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    change = spark.createDataFrame(
        [(5, 5, V.DA_TRA, V.TOT), (9, 2, V.HOAN_THANH, V.HONG)], STATUS + ", trang_thai_sach string")
    publish(spark, base, Changes(
        {"chi_tiet": rows_of(spark, "chi_tiet", [{"ma_phieu_muon": 901, "ma_sach": 3, "trang_thai_muon": V.DANG_MUON}])},
        {"chi_tiet": Update(change, ["trang_thai_muon", "trang_thai_sach"])}))
    compact(spark, base)  # not a change of its own
    publish(spark, base, status_change(spark, (5, 5, V.HOAN_THANH)))
    feed = changes_between(spark, base, "chi_tiet", 1)
    key = ["ma_phieu_muon", "ma_sach", "trang_thai_muon"]
    assert rows(feed.before, *key) == [(5, 5, V.DANG_MUON), (9, 2, V.DANG_MUON)]
    assert rows(feed.after, *key) == [(5, 5, V.HOAN_THANH), (9, 2, V.HOAN_THANH), (901, 3, V.DANG_MUON)]
    assert rows(restock_on_return(feed.before, feed.after), "ma_sach", "them") == [(5, 1)]
    assert rows(changes_between(spark, base, "chi_tiet", 1, 2).after, *key)[0] == (5, 5, V.DA_TRA)
    assert changes_between(spark, base, "chi_tiet", 2, 3).after.isEmpty()
    assert changes_between(spark, base, "sach", 1).before.isEmpty()
    whole = files_read(read_release(spark, base, 1).chi_tiet)
    assert whole >= 64 and files_read(feed.before) <= 3 + 4  # a file per bucket, and those that name the keys


def test_a_feed_over_a_replaced_table_compares_rows(spark, tmp_path):
    base = str(tmp_path / "lib")
    tables = small_library(spark)
    publish(spark, base, everything(tables))
    publish(spark, base, {"sach": apply_changes(
        tables.sach, spark.createDataFrame([(1, 5)], "ma_sach bigint, so_luong int"), ["ma_sach"], ["so_luong"])})
    feed = changes_between(spark, base, "sach", 1)
    assert rows(feed.before, "ma_sach", "so_luong") == [(1, 2)] and rows(feed.after, "ma_sach", "so_luong") == [(1, 5)]


def counts_of(tables):
    return (rows(tables.count_of("dem_sach"), "ma_sach", "trang_thai_muon", "so_dong"),
            rows(tables.count_of("dem_the"), "ma_the", "trang_thai_muon", "so_dong"))


def recounted(tables):
    lines = tables.chi_tiet
    on_card = lines.join(tables.phieu_muon, "ma_phieu_muon")
    return (rows(lines.groupBy("ma_sach", "trang_thai_muon").count(), "ma_sach", "trang_thai_muon", "count"),
            rows(on_card.groupBy("ma_the", "trang_thai_muon").count(), "ma_the", "trang_thai_muon", "count"))


def test_counts_are_kept_up(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    known = spark.createDataFrame([(7, 0, V.TRA_TRE, V.DANG_MUON)], STATUS + ", trang_thai_cu string")
    steps = [
        Changes({"chi_tiet": rows_of(spark, "chi_tiet", [{"ma_phieu_muon": 902, "ma_sach": 3, "trang_thai_muon": V.TRE_HAN}])}),
        status_change(spark, (5, 5, V.DA_TRA), (6, 6, None), (777, 1, V.DA_TRA)),
        Changes(updated={"chi_tiet": Update(known, ["trang_thai_muon"])}),
        Changes({"phieu_muon": rows_of(spark, "phieu_muon", [{"ma_phieu_muon": 2000, "ma_the": 3}]),
                 "chi_tiet": rows_of(spark, "chi_tiet", [{"ma_phieu_muon": 2000, "ma_sach": 1, "trang_thai_muon": V.DANG_MUON}])}),
        Changes(updated={"sach": Update(spark.createDataFrame([(1, 3)], "ma_sach bigint, so_luong int"), ["so_luong"])}),
    ]
    for step in steps:
        publish(spark, base, step)
        now = read_release(spark, base)
        assert counts_of(now) == recounted(now)
    compact(spark, base)
    now = read_release(spark, base)
    assert counts_of(now) == recounted(now) and len(current_release(spark, base).parts["dem_the"]) == 1
    publish(spark, base, {"chi_tiet": rows_of(spark, "chi_tiet", LINES[:10])})
    now = read_release(spark, base)
    assert counts_of(now) == recounted(now)


def test_measures_take_the_kept_up_counts(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(lines_library(spark)))
    publish(spark, base, status_change(spark, (5, 5, V.DA_TRA), (6, 6, V.TRE_HAN)))
    now = read_release(spark, base)
    plain = Tables(**everything(now))
    for measure, key, value in (
        (measures.stock_open4, "ma_sach", "so_luong_con_lai"), (measures.stock_open2, "ma_sach", "so_luong_con_lai"),
        (measures.reader_open_loans, "ma_doc_gia", "so_sach_dang_muon"),
    ):
        assert rows(measure(now), key, value) == rows(measure(plain), key, value)
        plan = plan_of(measure(now))
        assert "/chi_tiet/" not in plan and "/dem_" in plan and "/chi_tiet/" in plan_of(measure(plain))
    new = rows_of(spark, "chi_tiet", [{"ma_phieu_muon": 3, "ma_sach": 2}]).withColumn("statement_id", F.lit(1).cast("bigint"))
    found = checks.check_new_lines(now, new).violations
    assert rows(found, "ly_do", "khoa") == rows(checks.check_new_lines(plain, new).violations, "ly_do", "khoa")
    assert "/chi_tiet/" not in plan_of(found)
    assert now.having(chi_tiet=now.chi_tiet).count_of("dem_sach") is None
    assert now.having(sach=now.sach).count_of("dem_sach") is not None


def test_a_second_writer_fails(spark, tmp_path):
    base = str(tmp_path / "lib")
    publish(spark, base, everything(small_library(spark)))
    seen = current_release(spark, base)
    one, two = ({"hoa_don": rows_of(spark, "hoa_don", [{"ma_hoa_don": i}])} for i in (1, 2))
    assert publish(spark, base, Changes(one), after=seen) == 2
    with pytest.raises(AlreadyPublished):
        publish(spark, base, Changes(two), after=seen)
    assert rows(read_release(spark, base).hoa_don, "ma_hoa_don") == [(1,)]
    assert len(unused_places(spark, base, keep=2)) == 1  # what the second writer has left
    assert remove_unused(spark, base, keep=2) == 1 and unused_places(spark, base) == []
    assert rows(read_release(spark, base).hoa_don, "ma_hoa_don") == [(1,)]


def test_scratch_folder_is_the_one_the_session_names(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_steps_for_extensions_accounts_and_cards(spark, tmp_path):
    """Each step over a release gives what the batch over the same tables gives."""
    base = str(tmp_path / "lib")
    due = day("2001-08-10")
    people = {"trang_thai": V.HOAT_DONG, "password": "x"}
    publish(spark, base, everything(library_of(
        spark,
        sach=[{"ma_sach": k, "ten_sach": f"T{k}", "so_luong": 3} for k in (1, 2)],
        nhan_vien=[{"ma_nhan_vien": 1, "username": "a", **people}],
        doc_gia=[{"ma_doc_gia": k, "username": f"r{k}", **people} for k in (1, 2)],
        the_thu_vien=[{"ma_the": k, "ma_doc_gia": k, "trang_thai": V.HOAT_DONG} for k in (1, 2)],
        phieu_muon=[{"ma_phieu_muon": 5, "ma_the": 1}],
        chi_tiet=[{"ma_phieu_muon": 5, "ma_sach": k, "trang_thai_muon": V.DANG_MUON, "ngay_tra_du_kien": due} for k in (1, 2)],
        yeu_cau_gia_han=[
            {"ma_yeu_cau": k, "ma_phieu_muon": 5, "ma_sach": k, "ngay_tao": day("2001-07-20"), "ngay_gia_han": day("2001-08-24"),
             "trang_thai": V.DA_DUYET if k == 1 else V.CHO} for k in (1, 2)],
    )))
    asked = "request_id bigint, seq bigint, "
    run_step(spark, base, extensions_step(), spark.createDataFrame([(1, 1, 1), (2, 2, 1)], asked + "ma_yeu_cau bigint"))
    line = ["ma_sach", "trang_thai_muon", "ngay_tra_du_kien"]
    assert rows(read_release(spark, base).chi_tiet, *line) == [(1, V.DA_GIA_HAN, day("2001-08-24")), (2, V.DANG_MUON, due)]
    assert rows(read_outcome(spark, base), "request_id", "thanh_cong") == [(1, True), (2, False)]
    run_step(spark, base, decisions_step(), spark.createDataFrame(
        [(1, 1, 2, True), (2, 2, 1, False)], asked + "ma_yeu_cau bigint, chap_nhan boolean"))
    now = read_release(spark, base)
    assert rows(now.yeu_cau_gia_han, "ma_yeu_cau", "trang_thai") == [(1, V.TU_CHOI), (2, V.DA_DUYET)]
    assert rows(now.chi_tiet, *line)[1] == (2, V.DANG_MUON, day("2001-08-24"))
    run_step(spark, base, accounts_step(), spark.createDataFrame(
        [(1, 1, "a", "new", None), (2, 2, "r2", None, V.VO_HIEU)],
        asked + "username string, password_moi string, trang_thai_moi string"))
    now = read_release(spark, base)
    assert rows(now.nhan_vien, "password", "trang_thai") == [("new", V.HOAT_DONG)]
    assert rows(now.doc_gia, "username", "password", "trang_thai") == [("r1", "x", V.HOAT_DONG), ("r2", "x", V.VO_HIEU)]
    run_step(spark, base, cancellations_step(), spark.createDataFrame([(1, 1, 1), (2, 2, 2)], asked + "ma_doc_gia bigint"))
    now = read_release(spark, base)
    assert rows(now.the_thu_vien, "ma_the", "trang_thai") == [(1, V.HOAT_DONG), (2, V.BI_HUY)]
    assert rows(read_outcome(spark, base), "request_id", "thanh_cong") == [(1, False), (2, True)]
    assert counts_of(now) == recounted(now)


def test_results_in_buckets_join_without_a_shuffle_of_theirs(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = durable_by(spark.range(1000).selectExpr("id k", "id * 2 v"), "k")
        joined = spark.range(0, 2000, 3).withColumnRenamed("id", "k").join(held, "k")
        tree = plan_of(joined)
        tree = tree[: tree.index("\n\n")]
        assert tree.count("Exchange") == 1 and joined.count() == 334
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from circdesk.model import vocab as V
from circdesk.operators import admission, lending
from circdesk.operators import components as components_module
from circdesk.operators.admission import refused_requests
from circdesk.operators.components import components
from circdesk.operators.ordering import in_blocks, number_chosen, totals_before
from circdesk.sources.library import library_of
from tests.conftest import NOW, day, rows

LOAN = "request_id bigint, seq bigint, ma_the bigint, ma_nhan_vien bigint, danh_sach_sach string, so_ngay_muon int"
FAR = day("2002-01-01")


def card(key, status=V.HOAT_DONG, expiry=FAR):
    return {"ma_the": key, "trang_thai": status, "ngay_het_han": expiry, "ma_doc_gia": key}


@pytest.fixture(scope="module")
def lib(spark):
    return library_of(
        spark,
        sach=[{"ma_sach": k, "ten_sach": f"T{k}", "so_luong": 9} for k in range(1, 13)]
        + [{"ma_sach": 20, "ten_sach": "Cuối", "so_luong": 1}, {"ma_sach": 21, "ten_sach": "Hết", "so_luong": 1},
           {"ma_sach": 22, "ten_sach": "Rỗng", "so_luong": None}],
        the_thu_vien=[
            card(1), card(2, V.BI_KHOA), card(3, expiry=day("2001-07-31")), card(4),
            card(5, None, None), card(6), *[card(k) for k in range(10, 40)],
        ],
        phieu_muon=[
            {"ma_phieu_muon": 50, "ma_the": 4}, {"ma_phieu_muon": 51, "ma_the": 6},
        ],
        chi_tiet=[
            {"ma_phieu_muon": 50, "ma_sach": 1, "trang_thai_muon": V.DAT_TRUOC, "ngay_tra_du_kien": day("2001-07-01")},
            {"ma_phieu_muon": 51, "ma_sach": 21, "trang_thai_muon": V.DA_GIA_HAN, "ngay_tra_du_kien": FAR},
            *[{"ma_phieu_muon": 51, "ma_sach": k, "trang_thai_muon": V.DANG_MUON, "ngay_tra_du_kien": FAR} for k in (1, 2, 3, 4)],
        ],
    )


def test_reasons_in_order(spark, lib):
    cases = [
        (99, "1", 14, "card_not_found"), (2, "1", 14, "card_not_active"), (3, "1", 14, "card_expired"),
        (4, "1", 14, "overdue_debt"), (1, "1", 61, "term_too_long"), (1, "1", 0, "term_not_positive"),
        (1, "1,x", 14, "bad_item"), (1, "", 14, "bad_item"), (1, None, 14, "empty_list"),
        (1, "1,1", 14, "duplicate_book"),
        (1, ",".join(str(k) for k in range(1, 12)), 14, "too_many_books"),
        (1, "1,77,21", 14, "book_not_found"), (1, "21,77", 14, "out_of_stock"), (1, "22", 14, "out_of_stock"),
        (6, "5,6", 14, "loan_limit"), (10, "20", 14, None), (11, "20", 14, "out_of_stock"),
        (5, " 2 , 3", None, None), (12, "1,2,3,4,5,6", 14, "loan_limit"), (13, "1", 60, None),
    ]
    data = [(i, i, c, 1, books, days) for i, (c, books, days, _) in enumerate(cases)]
    batch = spark.createDataFrame(data, LOAN)
    made = lending.create_loans(lib, batch, NOW)
    found = rows(made.outcome, "request_id", "ly_do", "ma_phieu_muon", "thong_bao")
    assert [r[1] for r in found] == [c[3] for c in cases]
    assert [r[2] for r in found if r[2]] == [52, 53, 54]
    assert found[11][3] == "Sách có mã 77 không tồn tại!"
    assert found[12][3] == 'Sách "Hết" đã hết trong kho!'
    assert found[15][3] == "Tạo phiếu mượn thành công! Mã phiếu mượn: 52"
    assert rows(made.slips, "ma_phieu_muon", "tong_so_sach_muon", "ma_the") == [(52, 1, 10), (53, 2, 5), (54, 1, 13)]
    assert rows(made.lines, "ma_phieu_muon", "ma_sach", "ngay_tra_du_kien") == [
        (52, 20, day("2001-08-15")), (53, 2, None), (53, 3, None), (54, 1, day("2001-09-30"))
    ]
    # On its own, every request is judged against the stored tables alone.
    alone = rows(lending.screen_loans(lib, batch, NOW), "request_id", "ly_do")
    assert alone[16][1] is None
    assert [r[1] for i, r in enumerate(alone) if i != 16] == [c[3] for i, c in enumerate(cases) if i != 16]


def test_shelf_stock_ignores_open_loans_and_null_never_rejects(spark, lib):
    data = [(1, 1, 10, 1, "21", 14), (2, 2, 11, 1, "21", 14), (3, 3, 12, 1, "22", 14)]
    made = lending.create_loans(lib, spark.createDataFrame(data, LOAN), NOW, so_luong_is="on_shelf")
    assert rows(made.outcome, "request_id", "ly_do") == [(1, None), (2, "out_of_stock"), (3, None)]


def test_a_late_refusal_names_the_first_failing_book(spark, lib):
    # book 20 has one copy; request 2 lists an unknown book after it
    data = [(1, 1, 10, 1, "20", 14), (2, 2, 11, 1, "20,77", 14)]
    made = lending.create_loans(lib, spark.createDataFrame(data, LOAN), NOW)
    assert rows(made.outcome, "request_id", "ly_do") == [(1, None), (2, "out_of_stock")]


def test_default_term(spark, lib):
    batch = spark.createDataFrame([(1, 1, 10, 1, "1")], LOAN.rsplit(",", 1)[0])
    made = lending.create_loans(lib, batch, NOW)
    assert rows(made.lines, "ngay_tra_du_kien") == [(day("2001-08-15"),)]


@pytest.fixture
def many_blocks(spark):
    """Keep the blocks of a small batch from being merged into one."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield
    spark.conf.set(setting, "true")


def one_by_one(requests, capacity):
    """Admission the slow way: requests in order, all claims or none."""
    used, refused = defaultdict(int), set()
    for request, claims in sorted(requests.items()):
        if all(capacity.get(k) is None or used[k] + q <= capacity[k] for k, q in claims.items()):
            for k, q in claims.items():
                used[k] += q
        else:
            refused.add(request)
    return refused


def claim_rows(spark, requests, capacity):
    return in_blocks(spark.createDataFrame(
        [(r, r, kind, key, amount, capacity[(kind, key)]) for r, claims in requests.items() for (kind, key), amount in claims.items()],
        "request_id bigint, seq bigint, loai string, khoa bigint, so_luong bigint, suc_chua bigint",
    ))


def test_a_chain_is_settled_at_once(spark, monkeypatch):
    """Every request waits for the one before: passes alone would decide two at a time, in 100 steps."""
    requests = {i: {("sach", i): 1, ("sach", i + 1): 1} for i in range(200)}
    capacity = dict.fromkeys((k for c in requests.values() for k in c), 1)
    claims, written = claim_rows(spark, requests, capacity), []
    for module in (admission, components_module):
        write = module.durable
        monkeypatch.setattr(module, "durable", lambda df, write=write, **k: written.append(1) or write(df, **k))
    found = {r.request_id for r in refused_requests(claims).collect()}
    assert found == set(range(1, 200, 2)) == one_by_one(requests, capacity)
    assert len(written) < 30


@pytest.mark.parametrize("rows_per_task", [1_000_000, 3])
def test_chains_longer_than_one_step(spark, many_blocks, rows_per_task):
    """Chains of several lengths, tied into rings and combs, with more claims than are settled in one go."""
    rng = random.Random(rows_per_task)
    requests, capacity, at = {}, {}, 0
    for case, length in enumerate((2, 9, 30, 41)):
        for i in range(length):
            claims = {("sach", case * 1000 + i): rng.randint(1, 2), ("sach", case * 1000 + (i + 1) % length): 1}
            if i % 4 == 0:
                claims[("the", case * 1000 + i // 8)] = 1
            requests[at] = claims
            at += 1
        for key in {k for r in requests.values() for k in r} - set(capacity):
            capacity[key] = rng.randint(1, 3)
    requests[5000] = {k: 1 for k in list(capacity)[:30]}  # more claims than one step takes
    claims = claim_rows(spark, requests, capacity)
    found = {r.request_id for r in refused_requests(claims, rows_per_task, first_claims=25).collect()}
    assert found == one_by_one(requests, capacity)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 3])
def test_components_of_random_graphs(spark, rows_per_task):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7, 7), (400, 400)]
    pairs += [(500 + i, 501 + i) for i in range(70)] + [(1000, 1001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b", rows_per_task).collect()
    tied = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in tied)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


@pytest.mark.parametrize("rows_per_task", [1_000_000, 3])
def test_admission_equals_one_by_one(spark, many_blocks, rows_per_task):
    """Many random cases in one batch, apart from each other by their keys; one key is very popular."""
    rng = random.Random(rows_per_task)
    requests, capacity = {}, {}
    for case in range(60):
        keys = [("sach", case * 100 + k) for k in range(rng.randint(1, 6))] + [("the", case)]
        for key in keys:
            capacity[key] = rng.choice([None, 0, 1, 2, 3, 6])
        for _ in range(rng.randint(1, 14)):
            requests[rng.randrange(10**9)] = {
                k: rng.randint(1, 3) for k in rng.sample(keys, rng.randint(1, len(keys)))
            }
    popular = ("sach", 10**6)
    capacity[popular] = 40
    for request in list(requests)[::3]:
        requests[request][popular] = 1
    claims = claim_rows(spark, requests, capacity)
    found = {r.request_id for r in refused_requests(claims, rows_per_task).collect()}
    assert found == one_by_one(requests, capacity)


def test_nothing_is_refused_without_competition(spark):
    claims = in_blocks(
        spark.createDataFrame(
            [(1, 1, "sach", 1, 1, 5)],
            "request_id bigint, seq bigint, loai string, khoa bigint, so_luong bigint, suc_chua bigint",
        )
    )
    assert refused_requests(claims).count() == 0


def test_random_batches_of_loans_equal_one_by_one(spark):
    rng = random.Random(5)
    stock = {k: rng.randint(0, 4) for k in range(1, 31)}
    open_lines = [(60 + i % 7, rng.randint(1, 30)) for i in range(25)]
    open_lines = sorted(set(open_lines))
    lib = library_of(
        spark,
        sach=[{"ma_sach": k, "ten_sach": f"T{k}", "so_luong": n} for k, n in stock.items()],
        the_thu_vien=[card(k) for k in range(1, 41)],
        phieu_muon=[{"ma_phieu_muon": 60 + i, "ma_the": i + 1} for i in range(7)],
        chi_tiet=[
            {"ma_phieu_muon": s, "ma_sach": b, "trang_thai_muon": V.DANG_MUON, "ngay_tra_du_kien": FAR}
            for s, b in open_lines
        ],
    )
    asked = [
        (i, rng.randint(1, 40), [str(b) for b in rng.sample(range(1, 33), rng.randint(1, 4))])
        for i in range(160)
    ]
    data = [(i, i, c, 1, ",".join(books), 14) for i, c, books in asked]
    left = dict(stock)
    held = defaultdict(int)
    for slip, book in open_lines:
        left[book] -= 1
        held[slip - 59] += 1
    expected = {}
    for i, c, books in asked:
        reason = None
        for b in map(int, books):
            if b not in left:
                reason = "book_not_found"
            elif left[b] <= 0:
                reason = "out_of_stock"
            if reason:
                break
        if reason is None and held[c] + len(books) > 5:
            reason = "loan_limit"
        if reason is None:
            held[c] += len(books)
            for b in map(int, books):
                left[b] -= 1
        expected[i] = reason
    made = lending.create_loans(lib, spark.createDataFrame(data, LOAN), NOW)
    assert {r.request_id: r.ly_do for r in made.outcome.collect()} == expected
    assert len({r.ma_phieu_muon for r in made.slips.collect()}) == sum(v is None for v in expected.values())


def test_running_totals_split_a_hot_key(spark, many_blocks):
    rng = random.Random(2)
    data = [(i, i, 1 if i % 3 else rng.randint(2, 9), rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(data, "request_id bigint, seq bigint, khoa bigint, n bigint")
    blocked = in_blocks(df)
    assert blocked.select("_block").distinct().count() > 1
    expected, used = {}, defaultdict(int)
    for i, _, key, n in data:
        expected[i] = used[key]
        used[key] += n
    got = totals_before(blocked, ["khoa"], ["n"])
    assert {r.request_id: r.n_before for r in got.collect()} == expected


def test_ids_are_consecutive_in_order(spark, many_blocks):
    data = [(1000 - i, i, i % 2 == 0) for i in range(100)]
    df = in_blocks(spark.createDataFrame(data, "request_id bigint, seq bigint, pick boolean"))
    got = number_chosen(df, F.col("pick"), F.lit(None).cast("bigint"), "id")
    ids = [r.id for r in got.where("pick").orderBy("seq").collect()]
    assert ids == list(range(1, 51))
    assert got.where("not pick and id is not null").count() == 0

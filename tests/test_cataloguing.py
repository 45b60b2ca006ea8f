from decimal import Decimal

import pytest

from circdesk.model import messages as M
from circdesk.operators.cataloguing import ingest_books
from circdesk.sources.library import library_of
from tests.conftest import rows

D = Decimal
BOOK = (
    "request_id bigint, seq bigint, ten_sach string, hinh_anh string, mo_ta string, nha_xuat_ban string, "
    "so_luong int, don_gia decimal(10,2), ma_the_loai bigint, danh_sach_tac_gia string"
)


@pytest.fixture(scope="module")
def lib(spark):
    return library_of(
        spark,
        the_loai=[{"ma_the_loai": 1}],
        sach=[{"ma_sach": 10}],
        tac_gia=[
            {"ma_tac_gia": 1, "ten_tac_gia": "Nam Cao"}, {"ma_tac_gia": 2, "ten_tac_gia": "Tô Hoài"},
            {"ma_tac_gia": 3, "ten_tac_gia": "Tô Hoài"},
        ],
    )


def book(i, authors, title="T", stock=1, price="5.00", category=1):
    return (i, i, title, "img/a.jpg", None, "NXB", stock, D(price), category, authors)


def test_books_authors_and_links(spark, lib):
    batch = spark.createDataFrame(
        [
            book(1, "1,Mới,Mới"), book(2, "1", category=9), book(3, "1", title="  "), book(4, "1", stock=-1),
            book(5, "1", price="-0.01"), book(6, "Khác, 77,88"), book(7, None), book(8, " Tô Hoài ,Mới, Hai"),
            book(9, "  "), book(10, "2,2"), book(11, "Hai", title=None),
        ],
        BOOK,
    )
    made = ingest_books(lib, batch)
    found = rows(made.outcome, "request_id", "ly_do", "ma_sach", "thong_bao")
    assert [r[1] for r in found] == [
        None, "category_not_found", "blank_title", "negative_stock", "negative_price", "author_not_found",
        None, None, None, None, "blank_title",
    ]
    assert [r[2] for r in found if r[2]] == [11, 12, 13, 14, 15]
    assert found[5][3] == "Tác giả có mã 77 không tồn tại!"
    assert found[0][3] == "Thêm sách mới thành công! Mã sách: 11"
    # a name used only by failed requests creates nobody
    assert rows(made.authors, "ma_tac_gia", "ten_tac_gia", "mo_ta") == [
        (4, "Mới", M.NEW_AUTHOR_NOTE), (5, "Hai", M.NEW_AUTHOR_NOTE)
    ]
    assert rows(made.links, "ma_sach", "ma_tac_gia") == [
        (11, 1), (11, 4), (13, 2), (13, 4), (13, 5), (15, 2)
    ]
    assert made.books.columns == lib.sach.columns
    assert rows(made.books, "ma_sach", "so_luong", "don_gia") == [(k, 1, D(5)) for k in range(11, 16)]


def test_names_may_match_without_case(spark, lib):
    made = ingest_books(lib, spark.createDataFrame([book(1, "NAM CAO,mới"), book(2, "MỚI")], BOOK), "UNICODE_CI")
    assert rows(made.links, "ma_sach", "ma_tac_gia") == [(11, 1), (11, 4), (12, 4)]
    assert rows(made.authors, "ten_tac_gia") == [("mới",)]

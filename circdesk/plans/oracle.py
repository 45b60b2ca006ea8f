"""DuckDB SQL for the registered queries, on the same source tables.

``_BASE`` derives the library tables, ``_PARTS`` the request batches and shared facts; each query
is given only the parts it names.
"""

from __future__ import annotations

import re

from circdesk.model import messages as M
from circdesk.model import vocab as V
from circdesk.sources.derived import AS_OF, CATEGORIES, LINE_ID_SPAN

NOW = f"TIMESTAMP '{AS_OF}'"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


OPEN, HELD, CLOSED = _in(V.OPEN), _in(V.HELD), _in(V.CLOSED)
GOOD, DAMAGED, LOST = _in(V.GOOD), _in(V.DAMAGED), _in(V.LOST)
_CATEGORY = (
    "CASE p_type "
    + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(CATEGORIES, start=1))
    + " END"
)


def _person(key: str, name: str, id_base: int, phone_base: int, login: str) -> str:
    return (
        f"{name} AS ho_ten, CAST(NULL AS TIMESTAMP) AS ngay_sinh, CAST(NULL AS VARCHAR) AS dia_chi, "
        f"CAST({key} + {id_base} AS VARCHAR) AS cccd, "
        f"CAST({key} + {phone_base} AS VARCHAR) AS so_dien_thoai, "
        f"'{login}' || {key} AS username, 'h' || {key} AS password, '{V.HOAT_DONG}' AS trang_thai"
    )


def _days(start: str, end: str) -> str:
    return f"CAST(datediff('day', {start}, {end}) AS INTEGER)"


_LATE = (
    f"CASE WHEN ngay_tra_du_kien < coalesce(ngay_tra_thuc_te, {NOW}) "
    f"THEN datediff('day', ngay_tra_du_kien, coalesce(ngay_tra_thuc_te, {NOW})) ELSE 0 END"
)


def _replacement(condition: str, late: str = _LATE) -> str:
    return (
        f"CAST(CASE WHEN {condition} IN {LOST} THEN coalesce(don_gia, 0) "
        f"WHEN {condition} IN {DAMAGED} THEN coalesce(don_gia, 0) + ({late}) * 20000 "
        f"ELSE ({late}) * 20000 END AS DECIMAL(18,2))"
    )


_ADDITIVE = (
    f"CAST(CAST(CASE WHEN trang_thai_muon = '{V.TRE_HAN}' THEN "
    f"datediff('day', ngay_tra_du_kien, coalesce(ngay_tra_thuc_te, {NOW})) * 5000 ELSE 0 END "
    f"AS DECIMAL(18,2)) + CASE WHEN trang_thai_sach = '{V.HONG}' THEN don_gia * 0.3 "
    f"WHEN trang_thai_sach = '{V.MAT}' THEN don_gia ELSE 0 END AS DECIMAL(18,2))"
)

_LINE_ID = f"(ma_phieu_muon * {LINE_ID_SPAN} + ma_sach)"
_DUE = "(o_orderdate + INTERVAL 14 DAY)"
_IS_OPEN = (
    "(rf = 'N' AND ls = 'O' AND (o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' OR q = 50))"
)
_OVERDUE = (
    f"(trang_thai_muon IN {OPEN} AND ngay_tra_du_kien < {NOW} AND ngay_tra_thuc_te IS NULL)"
)
_LAST_BOOK = "(SELECT max(p_partkey) FROM part)"
_LAST_SLIP = "(SELECT max(o_orderkey) FROM orders)"

_PARTS: dict[str, str] = {
    "the_loai": f"SELECT DISTINCT CAST({_CATEGORY} AS BIGINT) AS ma_the_loai, p_type AS ten_the_loai, "
    "CAST(NULL AS VARCHAR) AS mo_ta FROM part",
    "sach": "SELECT p_partkey AS ma_sach, p_name AS ten_sach, CAST(NULL AS VARCHAR) AS hinh_anh, "
    "CAST(NULL AS VARCHAR) AS mo_ta, p_brand AS nha_xuat_ban, p_size % 4 AS so_luong, "
    f"CAST(p_retailprice AS DECIMAL(10,2)) AS don_gia, CAST({_CATEGORY} AS BIGINT) AS ma_the_loai FROM part",
    "tac_gia": "SELECT s_suppkey AS ma_tac_gia, s_name AS ten_tac_gia, CAST(NULL AS VARCHAR) AS mo_ta "
    "FROM supplier",
    "tac_gia_sach": "SELECT DISTINCT l_suppkey AS ma_tac_gia, l_partkey AS ma_sach FROM lineitem",
    "nhan_vien": "SELECT CAST(n_nationkey AS BIGINT) AS ma_nhan_vien, "
    + _person("n_nationkey", "n_name", 1_000_000_000, 8_000_000_000, "nv")
    + " FROM nation",
    "doc_gia": "SELECT c_custkey AS ma_doc_gia, "
    + _person("c_custkey", "c_name", 2_000_000_000, 9_000_000_000, "dg")
    + " FROM customer",
    "the_thu_vien": "SELECT c_custkey AS ma_the, "
    "TIMESTAMP '2001-07-01 00:00:00' + to_days(CAST(c_custkey % 400 AS INTEGER)) AS ngay_het_han, "
    f"CASE WHEN c_acctbal < 0 THEN '{V.BI_KHOA}' ELSE '{V.HOAT_DONG}' END AS trang_thai, "
    "c_custkey AS ma_doc_gia FROM customer",
    "chi_tiet": f"""SELECT l_orderkey AS ma_phieu_muon, l_partkey AS ma_sach,
      {_DUE} AS ngay_tra_du_kien,
      CASE WHEN NOT {_IS_OPEN} THEN o_orderdate + to_days(q) END AS ngay_tra_thuc_te,
      CASE WHEN {_IS_OPEN} AND ln = 7 THEN '{V.DAT_TRUOC}'
           WHEN {_IS_OPEN} AND ln = 3 THEN '{V.DA_GIA_HAN}'
           WHEN {_IS_OPEN} AND {_DUE} < {NOW} AND ln % 2 = 1 THEN '{V.TRE_HAN}'
           WHEN {_IS_OPEN} THEN '{V.DANG_MUON}'
           WHEN q <= 14 AND ls = 'F' THEN '{V.HOAN_THANH}'
           WHEN q <= 14 THEN '{V.DA_TRA}'
           WHEN q = 16 AND di = 10 THEN '{V.TRE_HAN}'
           ELSE '{V.TRA_TRE}' END AS trang_thai_muon,
      CASE WHEN {_IS_OPEN} THEN NULL WHEN di = 10 AND tx = 8 THEN '{V.MAT}'
           WHEN di = 10 THEN '{V.HONG}' ELSE '{V.TOT}' END AS trang_thai_sach
    FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS ln,
            min(CAST(trunc(l_quantity) AS INTEGER)) AS q, min(l_returnflag) AS rf,
            min(l_linestatus) AS ls, min(CAST(round(l_discount * 100) AS INTEGER)) AS di,
            min(CAST(round(l_tax * 100) AS INTEGER)) AS tx
          FROM lineitem GROUP BY l_orderkey, l_partkey) g
    JOIN orders ON o_orderkey = l_orderkey""",
    "phieu_muon": "SELECT o_orderkey AS ma_phieu_muon, o_orderdate AS ngay_lap, "
    "CAST(coalesce(n, 0) AS INTEGER) AS tong_so_sach_muon, o_custkey AS ma_the, "
    "o_orderkey % 25 AS ma_nhan_vien FROM orders LEFT JOIN "
    "(SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) c "
    "ON l_orderkey = o_orderkey",
    "hoa_don": "SELECT o_orderkey AS ma_hoa_don, o_orderdate AS ngay_lap, "
    "CAST(o_totalprice AS DECIMAL(18,2)) AS so_tien, CASE o_orderkey % 4 "
    f"WHEN 0 THEN '{V.TEXT_LATE}' WHEN 1 THEN '{V.TEXT_LOST}' WHEN 2 THEN '{V.TEXT_DAMAGED}' "
    f"ELSE '{V.TEXT_CARD}' END AS noi_dung, o_custkey AS ma_doc_gia, "
    "o_orderkey % 25 AS ma_nhan_vien FROM orders",
    "yeu_cau_gia_han": f"""SELECT {_LINE_ID} AS ma_yeu_cau, ma_phieu_muon, ma_sach,
      CASE WHEN ngay_tra_thuc_te IS NULL THEN {NOW} - to_days(CAST(ma_sach % 8 AS INTEGER))
           ELSE ngay_tra_du_kien - to_days(CAST(ma_sach % 15 AS INTEGER)) END AS ngay_tao,
      ngay_tra_du_kien + INTERVAL 14 DAY AS ngay_gia_han,
      CASE (ma_phieu_muon + ma_sach) % 3 WHEN 0 THEN '{V.CHO}' WHEN 1 THEN '{V.DA_DUYET}'
           ELSE '{V.TU_CHOI}' END AS trang_thai
    FROM chi_tiet WHERE ngay_tra_thuc_te IS NULL OR trang_thai_muon = '{V.TRA_TRE}'""",
    # -- request batches
    "loan_requests": f"""SELECT event_id AS request_id, event_id AS seq,
      user_id * 10 + event_id % 11 AS ma_the, event_id % 25 AS ma_nhan_vien,
      CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN b1 || ',' || b1
           WHEN event_id % 73 = 0 THEN b1 || ',' || b2 || ',x'
           WHEN event_id % 71 = 0 THEN repeat(b1 || ',' || b2 || ',', 5) || b1 || ',' || b2
           ELSE b1 || ',' || b2 END AS danh_sach_sach,
      CASE WHEN event_id % 97 = 0 THEN 90 WHEN event_id % 89 = 0 THEN 0 ELSE 14 END AS so_ngay_muon
    FROM (SELECT *, CAST(event_id % ({_LAST_BOOK} + 5) AS VARCHAR) AS b1,
                 CAST((event_id * 7) % ({_LAST_BOOK} + 1) AS VARCHAR) AS b2 FROM events) e""",
    "return_requests": f"""SELECT {_LINE_ID} AS request_id, {_LINE_ID} AS seq, ma_phieu_muon, ma_sach,
      CASE ma_sach % 5 WHEN 0 THEN '{V.TOT}' WHEN 1 THEN '{V.NGUYEN_VEN}' WHEN 2 THEN '{V.HONG}'
           WHEN 3 THEN '{V.MAT}' ELSE 'Ướt' END AS dieu_kien, ma_sach % 25 AS ma_nhan_vien
    FROM chi_tiet""",
    "extension_applications": "SELECT ma_yeu_cau * 2 + lan AS request_id, ma_yeu_cau * 2 + lan AS seq, "
    "ma_yeu_cau FROM yeu_cau_gia_han, (VALUES (0), (1)) v(lan)",
    "extension_decisions": """SELECT ma_yeu_cau * 2 + lan AS request_id, ma_yeu_cau * 2 + lan AS seq,
      ma_yeu_cau, CASE (ma_phieu_muon + ma_sach * (lan + 1)) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END
      AS chap_nhan FROM yeu_cau_gia_han, (VALUES (0), (1)) v(lan)""",
    "account_patches": f"""SELECT event_id AS request_id, event_id AS seq,
      CASE WHEN event_type = 'error' THEN 'nv' || (event_id % 30)
           ELSE 'dg' || (user_id * 11 + event_id % 11) END AS username,
      CASE WHEN event_type IN ('signup', 'error') THEN 'p' || event_id END AS password_moi,
      CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN event_id % 2 = 0
           THEN '{V.HOAT_DONG}' ELSE '{V.VO_HIEU}' END END AS trang_thai_moi FROM events""",
    "cancellation_requests": "SELECT c_custkey AS request_id, c_custkey AS seq, "
    "c_custkey + 1 AS ma_doc_gia FROM customer",
    "new_books": """SELECT p_partkey AS request_id, p_partkey AS seq,
      CASE WHEN p_size = 9 THEN '  ' ELSE p_name END AS ten_sach, p_size - 3 AS so_luong,
      CAST(p_retailprice - 905 AS DECIMAL(10,2)) AS don_gia, CAST(p_size % 8 AS BIGINT) AS ma_the_loai,
      CASE p_partkey % 6 WHEN 0 THEN NULL
        WHEN 1 THEN (p_partkey % ((SELECT max(s_suppkey) FROM supplier) + 9)) || ', ' || p_name
        WHEN 2 THEN p_name || ',' || p_name || ' ,Supplier#000000001'
        ELSE p_name || ' ' || p_type || ',0' END AS danh_sach_tac_gia FROM part""",
    "inserted_slips": "SELECT event_id // 3 AS statement_id, event_id AS ma_phieu_muon, "
    f"{NOW} AS ngay_lap, 1 AS tong_so_sach_muon, user_id * 10 + event_id % 11 AS ma_the, "
    "event_id % 25 AS ma_nhan_vien FROM events",
    "inserted_extensions": "SELECT ma_phieu_muon AS statement_id, ma_phieu_muon, ma_sach, "
    f"{NOW} AS ngay_tao, ngay_tra_du_kien + INTERVAL 14 DAY AS ngay_gia_han, "
    f"'{V.CHO}' AS trang_thai FROM chi_tiet",
    "returned_lines": f"""SELECT ma_phieu_muon AS statement_id, ma_phieu_muon, ma_sach,
      CASE WHEN ma_sach % 2 = 0 THEN '{V.DA_TRA}' ELSE '{V.HOAN_THANH}' END AS tt_moi,
      CASE ma_sach % 3 WHEN 0 THEN '{V.TOT}' WHEN 1 THEN '{V.NGUYEN_VEN}' ELSE '{V.HONG}' END AS ts_moi,
      trang_thai_muon AS tt_cu FROM chi_tiet""",
    # -- shared facts
    "cards_in_debt": "SELECT DISTINCT ma_the FROM chi_tiet JOIN phieu_muon USING (ma_phieu_muon) "
    f"WHERE {_OVERDUE}",
    "held_per_card": "SELECT ma_the, count(*) AS n FROM chi_tiet JOIN phieu_muon USING (ma_phieu_muon) "
    f"WHERE trang_thai_muon = '{V.DANG_MUON}' GROUP BY ma_the",
    "held_per_reader": "SELECT ma_doc_gia, count(ma_sach) AS n FROM chi_tiet "
    "JOIN phieu_muon USING (ma_phieu_muon) JOIN the_thu_vien USING (ma_the) "
    f"WHERE trang_thai_muon IN {HELD} GROUP BY ma_doc_gia",
    "stock4": "SELECT ma_sach, coalesce(so_luong - (SELECT count(*) FROM chi_tiet c WHERE c.ma_sach = s.ma_sach "
    f"AND c.trang_thai_muon IN {OPEN}), 0) AS so_luong_con_lai FROM sach s",
    "stock2": "SELECT ma_sach, coalesce(so_luong, 0) - (SELECT count(*) FROM chi_tiet c "
    f"WHERE c.ma_sach = s.ma_sach AND c.trang_thai_muon IN {HELD}) AS so_luong_con_lai FROM sach s",
    "slip_reader": "SELECT ma_phieu_muon, ma_the, ma_doc_gia, ho_ten, so_dien_thoai FROM phieu_muon "
    "JOIN the_thu_vien USING (ma_the) JOIN doc_gia USING (ma_doc_gia)",
}


def _inserted_lines(per_statement: int) -> str:
    return f"""SELECT event_id // {per_statement} AS statement_id,
      (user_id * 97) % ({_LAST_SLIP} + 1) AS ma_phieu_muon,
      unnest([event_id % ({_LAST_BOOK} + 5), (event_id * 7) % ({_LAST_BOOK} + 1)]) AS ma_sach
      FROM events"""


for _n in (1, 2, 4, 20):
    _PARTS[f"new_lines_{_n}"] = _inserted_lines(_n)
    _PARTS[f"short_{_n}"] = f"""SELECT statement_id, d.ma_sach, nhu_cau, CAST(so_luong AS BIGINT) AS so_luong,
      '{M.NOT_ENOUGH_STOCK}' AS thong_bao
      FROM (SELECT statement_id, ma_sach, count(*) AS nhu_cau FROM new_lines_{_n} GROUP BY 1, 2) d
      JOIN sach s ON s.ma_sach = d.ma_sach WHERE so_luong < nhu_cau"""
    _PARTS[f"over_{_n}"] = f"""SELECT statement_id, w.ma_the, muon_moi, coalesce(n, 0) AS dang_muon,
      '{M.LOAN_LIMIT}' AS thong_bao
      FROM (SELECT statement_id, ma_the, count(i.ma_sach) AS muon_moi FROM new_lines_{_n} i
            JOIN phieu_muon USING (ma_phieu_muon) GROUP BY 1, 2) w
      LEFT JOIN held_per_card h ON h.ma_the = w.ma_the WHERE muon_moi + coalesce(n, 0) > 5"""


def _one_after_another(claims: str, name: str) -> dict[str, str]:
    """Admission as a recursive query that takes one request in each step: ``<name>`` lists the refused ones.

    The state is what has been taken of each key. Requests without a key that is asked for beyond its
    capacity take no part: all of them fit.
    """
    return {
        f"{name}_tight": f"SELECT loai, khoa FROM {claims} GROUP BY ALL HAVING sum(so_luong) > max(suc_chua)",
        f"{name}_turn": f"""SELECT request_id, row_number() OVER (ORDER BY request_id) AS n
          FROM (SELECT DISTINCT request_id FROM {claims} JOIN {name}_tight USING (loai, khoa)) x""",
        f"{name}_asks": f"""SELECT n, list(struct_pack(k := loai || khoa, q := so_luong, r := suc_chua)) AS c
          FROM {claims} JOIN {name}_tight USING (loai, khoa) JOIN {name}_turn USING (request_id) GROUP BY n""",
        f"{name}_run": f"""SELECT CAST(0 AS BIGINT) AS n, TRUE AS ok, MAP([]::VARCHAR[], []::HUGEINT[]) AS lay
          UNION ALL
          SELECT n, ok, CASE WHEN ok THEN map_concat(lay, map_from_entries(list_transform(c,
              lambda x: struct_pack(k := x.k, v := CAST(coalesce(lay[x.k], 0) + x.q AS HUGEINT))))) ELSE lay END
          FROM (SELECT a.n, a.c, r.lay,
                  list_bool_and(list_transform(a.c, lambda x: coalesce(r.lay[x.k], 0) + x.q <= x.r)) AS ok
                FROM {name}_run r JOIN {name}_asks a ON a.n = r.n + 1) s""",
        name: f"SELECT request_id FROM {name}_run JOIN {name}_turn USING (n) WHERE NOT ok",
    }


def _screen(so_luong_is: str) -> dict[str, str]:
    room = "CAST(k.so_luong_con_lai AS BIGINT)" if so_luong_is == "total" else "CAST(s.so_luong AS BIGINT)"
    stock = "JOIN stock4 k ON k.ma_sach = s.ma_sach" if so_luong_is == "total" else ""
    tag = "" if so_luong_is == "total" else "_shelf"
    parts = {
        "screened": f"""SELECT r.*, coalesce(len(ma), 0) AS so_sach, coalesce(h.n, 0) AS dang_muon,
          CASE WHEN t.ma_the IS NULL THEN 'card_not_found'
               WHEN t.trang_thai <> '{V.HOAT_DONG}' THEN 'card_not_active'
               WHEN t.ngay_het_han < {NOW} THEN 'card_expired'
               WHEN d.ma_the IS NOT NULL THEN 'overdue_debt'
               WHEN so_ngay_muon > 60 THEN 'term_too_long'
               WHEN so_ngay_muon <= 0 THEN 'term_not_positive'
               WHEN len(list_filter(ma, lambda x: x IS NULL)) > 0 THEN 'bad_item'
               WHEN coalesce(len(ma), 0) > 10 THEN 'too_many_books'
               WHEN coalesce(len(ma), 0) = 0 THEN 'empty_list'
               WHEN len(list_distinct(ma)) < len(ma) THEN 'duplicate_book' END AS ly_do_1,
          t.trang_thai AS tt_the
        FROM (SELECT *, list_transform(string_split(danh_sach_sach, ','),
                lambda x: TRY_CAST(trim(x) AS BIGINT)) AS ma FROM loan_requests) r
        LEFT JOIN the_thu_vien t ON t.ma_the = r.ma_the
        LEFT JOIN cards_in_debt d ON d.ma_the = r.ma_the
        LEFT JOIN held_per_card h ON h.ma_the = r.ma_the""",
        f"asked{tag}": f"""SELECT a.*, s.ma_sach IS NOT NULL AS co_sach, s.ten_sach, {room} AS suc_chua
        FROM (SELECT request_id, ma_the, so_sach, dang_muon, unnest(ma) AS ma_sach,
                generate_subscripts(ma, 1) - 1 AS vi_tri FROM screened WHERE ly_do_1 IS NULL) a
        LEFT JOIN (sach s {stock}) ON s.ma_sach = a.ma_sach""",
        f"able{tag}": f"""SELECT request_id FROM asked{tag} GROUP BY request_id
        HAVING bool_and(co_sach AND coalesce(suc_chua > 0, TRUE) AND dang_muon + so_sach <= 5)""",
        f"all_claims{tag}": f"""SELECT request_id, 'sach' AS loai, ma_sach AS khoa, 1 AS so_luong, suc_chua,
          vi_tri, ten_sach, co_sach FROM asked{tag}
        UNION ALL
        SELECT request_id, 'the', ma_the, so_sach, 5 - dang_muon, 1000000, NULL, NULL
        FROM asked{tag} WHERE vi_tri = 0""",
        f"claims{tag}": f"SELECT * FROM all_claims{tag} WHERE request_id IN (FROM able{tag})",
    }
    parts |= _one_after_another(f"claims{tag}", f"refused{tag}")
    parts |= {
        f"used{tag}": f"""SELECT *, coalesce(sum(CASE WHEN nhan THEN so_luong END) OVER
            (PARTITION BY loai, khoa ORDER BY request_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lay
          FROM (SELECT *, request_id IN (FROM able{tag}) AND request_id NOT IN (FROM refused{tag}) AS nhan
                FROM all_claims{tag}) a""",
        f"second{tag}": f"""SELECT request_id, arg_min(ly_do, vi_tri) AS ly_do_2, arg_min(loi, vi_tri) AS loi_2
          FROM (SELECT request_id, vi_tri,
              CASE WHEN loai = 'the' THEN CASE WHEN lay + so_luong > suc_chua THEN 'loan_limit' END
                   WHEN NOT co_sach THEN 'book_not_found'
                   WHEN suc_chua - lay <= 0 THEN 'out_of_stock' END AS ly_do,
              CASE WHEN loai = 'the' THEN '{M.LOAN_LIMIT}'
                   WHEN NOT co_sach THEN 'Sách có mã ' || khoa || ' không tồn tại!'
                   ELSE 'Sách "' || ten_sach || '" đã hết trong kho!' END AS loi
            FROM used{tag} WHERE NOT nhan) x WHERE ly_do IS NOT NULL GROUP BY request_id""",
        f"loans{tag}": f"""SELECT r.*, coalesce(ly_do_1, ly_do_2) AS ly_do, loi_2,
            CASE WHEN ly_do_1 IS NULL AND ly_do_2 IS NULL THEN
              (SELECT max(ma_phieu_muon) FROM phieu_muon) + row_number() OVER
                (PARTITION BY ly_do_1 IS NULL AND ly_do_2 IS NULL ORDER BY seq) END AS ma_phieu_muon
          FROM screened r LEFT JOIN second{tag} b ON b.request_id = r.request_id""",
    }
    return parts


_PARTS |= _screen("total") | _screen("on_shelf")

_LOAN_TEXT = f"""CASE ly_do_1
  WHEN 'card_not_found' THEN 'Thẻ thư viện không tồn tại!'
  WHEN 'card_not_active' THEN 'Thẻ thư viện không còn hoạt động! Trạng thái: ' || tt_the
  WHEN 'card_expired' THEN 'Thẻ thư viện đã hết hạn!'
  WHEN 'overdue_debt' THEN 'Độc giả đang có sách mượn quá hạn chưa trả. Vui lòng trả sách trước khi mượn mới!'
  WHEN 'term_too_long' THEN 'Thời gian mượn tối đa là 60 ngày (2 tháng)!'
  WHEN 'term_not_positive' THEN 'Thời gian mượn phải lớn hơn 0!'
  WHEN 'bad_item' THEN 'Lỗi: mã sách không hợp lệ'
  WHEN 'too_many_books' THEN 'Mỗi lần chỉ được mượn tối đa 10 cuốn sách!'
  WHEN 'empty_list' THEN 'Danh sách sách không được để trống!'
  WHEN 'duplicate_book' THEN 'Lỗi: một sách có hai lần trong danh sách' END"""

_PARTS |= {
    "alone": f"""SELECT request_id, arg_min(ly_do, vi_tri) AS ly_do_2, arg_min(loi, vi_tri) AS loi_2
      FROM (SELECT request_id, vi_tri,
          CASE WHEN loai = 'the' THEN CASE WHEN so_luong > suc_chua THEN 'loan_limit' END
               WHEN NOT co_sach THEN 'book_not_found'
               WHEN suc_chua <= 0 THEN 'out_of_stock' END AS ly_do,
          CASE WHEN loai = 'the' THEN '{M.LOAN_LIMIT}'
               WHEN NOT co_sach THEN 'Sách có mã ' || khoa || ' không tồn tại!'
               ELSE 'Sách "' || ten_sach || '" đã hết trong kho!' END AS loi
        FROM all_claims) x WHERE ly_do IS NOT NULL GROUP BY request_id""",
    "line_claims": """SELECT statement_id AS request_id, 'sach' AS loai, d.ma_sach AS khoa, so_luong_moi AS so_luong,
        CAST(s.so_luong AS BIGINT) AS suc_chua
      FROM (SELECT statement_id, ma_sach, count(*) AS so_luong_moi FROM new_lines_2 GROUP BY 1, 2) d
      JOIN sach s ON s.ma_sach = d.ma_sach
      UNION ALL
      SELECT statement_id, 'the', w.ma_the, moi, 5 - coalesce(n, 0)
      FROM (SELECT statement_id, ma_the, count(*) AS moi FROM new_lines_2
            JOIN phieu_muon USING (ma_phieu_muon) GROUP BY 1, 2) w
      LEFT JOIN held_per_card h ON h.ma_the = w.ma_the""",
    # extensions
    "ext_facts": f"""SELECT a.request_id, a.seq, y.*, c.ma_sach AS co_dong, c.trang_thai_muon, y.trang_thai AS tt,
        CASE WHEN y.trang_thai <> '{V.DA_DUYET}' THEN 'not_approved'
             WHEN c.trang_thai_muon = '{V.DA_GIA_HAN}' THEN 'already_extended'
             WHEN datediff('day', ngay_tao, ngay_tra_du_kien) < 7 THEN 'too_late' END AS ly_do_1
      FROM extension_applications a JOIN yeu_cau_gia_han y ON y.ma_yeu_cau = a.ma_yeu_cau
      JOIN chi_tiet c ON c.ma_phieu_muon = y.ma_phieu_muon AND c.ma_sach = y.ma_sach""",
    "ext_done": """SELECT *, CASE WHEN ly_do_1 = 'not_approved' THEN ly_do_1
        WHEN coalesce(seq > min(CASE WHEN ly_do_1 IS NULL THEN seq END)
             OVER (PARTITION BY ma_phieu_muon, ma_sach), FALSE) THEN 'already_extended'
        ELSE ly_do_1 END AS ly_do FROM ext_facts""",
    "decided": """SELECT d.*, y.ma_phieu_muon, y.ma_sach, y.ngay_gia_han
      FROM extension_decisions d JOIN yeu_cau_gia_han y USING (ma_yeu_cau)""",
    # returns
    "ret_facts": f"""SELECT r.*, c.trang_thai_muon, c.ngay_tra_du_kien, s.don_gia, t.ma_doc_gia,
        datediff('day', c.ngay_tra_du_kien, {NOW}) AS tre,
        CASE WHEN dieu_kien IN {GOOD} THEN '{V.NGUYEN_VEN}' WHEN dieu_kien IN {DAMAGED} THEN '{V.HU_HONG_NANG}'
             WHEN dieu_kien IN {LOST} THEN '{V.MAT_SACH}' END AS ts_moi,
        CASE WHEN c.ngay_tra_thuc_te IS NOT NULL OR c.trang_thai_muon IN {CLOSED} THEN 'already_returned'
             WHEN datediff('day', c.ngay_tra_du_kien, {NOW}) > 30 THEN 'over_30_days_late'
             WHEN dieu_kien NOT IN {_in((*V.GOOD, *V.DAMAGED, *V.LOST))} THEN 'bad_condition' END AS ly_do
      FROM return_requests r JOIN chi_tiet c USING (ma_phieu_muon, ma_sach) JOIN sach s USING (ma_sach)
      JOIN phieu_muon p USING (ma_phieu_muon) JOIN the_thu_vien t ON t.ma_the = p.ma_the""",
    "ret_fined": f"""SELECT *, CASE WHEN tre <= 0 THEN '{V.HOAN_THANH}' ELSE '{V.TRA_TRE}' END AS tt_moi,
        CASE WHEN ly_do IS NULL THEN {_replacement("ts_moi", "greatest(tre, 0)")} END AS tien_phat
      FROM ret_facts""",
    "ret_done": """SELECT *, CASE WHEN tien_phat > 0 THEN (SELECT max(ma_hoa_don) FROM hoa_don)
        + row_number() OVER (PARTITION BY coalesce(tien_phat > 0, FALSE) ORDER BY seq) END AS ma_hoa_don
      FROM ret_fined""",
    # new books
    "book_items": """SELECT request_id, seq, trim(muc) AS muc, vi_tri,
        regexp_full_match(trim(muc), '[+-]?[0-9]+') AS la_ma
      FROM (SELECT request_id, seq, unnest(string_split(danh_sach_tac_gia, ',')) AS muc,
              generate_subscripts(string_split(danh_sach_tac_gia, ','), 1) - 1 AS vi_tri
            FROM new_books WHERE trim(danh_sach_tac_gia) <> '') x""",
    "bad_authors": """SELECT request_id, arg_min(muc, vi_tri) AS muc FROM book_items
      WHERE la_ma AND TRY_CAST(CASE WHEN la_ma THEN muc END AS BIGINT) NOT IN (SELECT ma_tac_gia FROM tac_gia)
      GROUP BY request_id""",
    "books_done": """SELECT *, CASE WHEN ly_do IS NULL THEN (SELECT max(ma_sach) FROM sach) + row_number()
        OVER (PARTITION BY ly_do IS NULL ORDER BY seq) END AS ma_sach
      FROM (SELECT b.*, a.muc, CASE WHEN t.ma_the_loai IS NULL THEN 'category_not_found'
              WHEN trim(coalesce(ten_sach, '')) = '' THEN 'blank_title'
              WHEN so_luong < 0 THEN 'negative_stock' WHEN don_gia < 0 THEN 'negative_price'
              WHEN a.muc IS NOT NULL THEN 'author_not_found' END AS ly_do
            FROM new_books b LEFT JOIN the_loai t USING (ma_the_loai)
            LEFT JOIN bad_authors a USING (request_id)) x""",
    "wanted": """SELECT i.*, d.ma_sach FROM book_items i JOIN books_done d USING (request_id)
      WHERE d.ly_do IS NULL""",
    "new_names": """SELECT muc, (SELECT max(ma_tac_gia) FROM tac_gia) + row_number() OVER (ORDER BY s, v)
        AS ma_tac_gia
      FROM (SELECT muc, min(seq) AS s, arg_min(vi_tri, seq * 1000 + vi_tri) AS v FROM wanted
            WHERE NOT la_ma AND muc NOT IN (SELECT ten_tac_gia FROM tac_gia) GROUP BY muc) x""",
    # accounts
    "patched": """SELECT username, arg_max(password_moi, seq) FILTER (password_moi IS NOT NULL) AS password_moi,
        arg_max(trang_thai_moi, seq) FILTER (trang_thai_moi IS NOT NULL) AS trang_thai_moi
      FROM account_patches GROUP BY username""",
    # cards
    "cancelled": f"""SELECT q.*, CASE WHEN g.ma_doc_gia IS NULL THEN 'not_found'
        WHEN h.ma_doc_gia IS NOT NULL THEN 'has_open_loans' END AS ly_do
      FROM cancellation_requests q LEFT JOIN doc_gia g ON g.ma_doc_gia = q.ma_doc_gia
      LEFT JOIN held_per_reader h ON h.ma_doc_gia = q.ma_doc_gia""",
}


def _unique(existing: str, key: str, rows: str, own: bool) -> str:
    other = f" AND e.{key} <> i.{key}" if own else ""
    half = (
        "SELECT statement_id, i.{key}, '{c}' AS cot, i.{c} AS gia_tri, 'exists' AS ly_do, "
        "'{msg}' AS thong_bao FROM ({rows}) i "
        "WHERE EXISTS (SELECT 1 FROM {existing} e WHERE e.{c} = i.{c}{other})"
    )
    return " UNION ALL ".join(
        half.format(key=key, c=c, msg=M.PERSON_EXISTS, rows=rows, existing=existing, other=other)
        for c in ("cccd", "so_dien_thoai")
    )


def _shifted(table: str, key: str, new_key: str, cccd: str, phone: str) -> str:
    return (
        f"SELECT {key} AS statement_id, {new_key} AS {key}, CAST({cccd} AS VARCHAR) AS cccd, "
        f"CAST({phone} AS VARCHAR) AS so_dien_thoai FROM {table}"
    )


def _revenue(unit: str) -> str:
    return (
        f"SELECT CAST(date_trunc('{unit}', ngay_lap) AS DATE) AS ky, count(*) AS so_hoa_don, "
        "CAST(sum(so_tien) AS DECIMAL(18,2)) AS doanh_thu FROM hoa_don GROUP BY 1"
    )


def _damage(unit: str) -> str:
    return (
        f"SELECT CAST(date_trunc('{unit}', ngay_tra_thuc_te) AS DATE) AS ky, count(*) AS so_tra, "
        f"count(*) FILTER (trang_thai_sach IN {DAMAGED}) AS so_hong, "
        f"count(*) FILTER (trang_thai_sach IN {LOST}) AS so_mat, "
        f"CAST(count(*) FILTER (trang_thai_sach IN {DAMAGED}) AS DOUBLE) / CAST(count(*) AS DOUBLE) "
        "AS ty_le_hong FROM chi_tiet WHERE ngay_tra_thuc_te IS NOT NULL GROUP BY 1"
    )


def _restock(old: tuple[str, ...], new: tuple[str, ...], good: tuple[str, ...]) -> str:
    return (
        "SELECT ma_sach, count(DISTINCT statement_id) AS them FROM returned_lines "
        f"WHERE tt_cu IN {_in(old)} AND tt_moi IN {_in(new)} AND ts_moi IN {_in(good)} GROUP BY ma_sach"
    )


_LINE_COLUMNS = (
    "ma_phieu_muon, ma_sach, ngay_tra_du_kien, ngay_tra_thuc_te, trang_thai_muon, trang_thai_sach"
)
_NEW_LINE = (
    f"{NOW} + INTERVAL 14 DAY AS ngay_tra_du_kien, CAST(NULL AS TIMESTAMP) AS ngay_tra_thuc_te, "
    f"'{V.DANG_MUON}' AS trang_thai_muon, CAST(NULL AS VARCHAR) AS trang_thai_sach"
)
_EXT_TEXT = f"""CASE ly_do
  WHEN 'not_approved' THEN 'Yêu cầu gia hạn chưa được duyệt! Trạng thái hiện tại: ' || tt
  WHEN 'already_extended' THEN '{M.EXTENDED_ALREADY}' WHEN 'too_late' THEN '{M.EXTENDED_TOO_LATE}'
  ELSE 'Gia hạn sách thành công! Ngày trả dự kiến mới: ' || strftime(ngay_gia_han, '%d/%m/%Y') END"""
_RET_TEXT = f"""CASE ly_do WHEN 'already_returned' THEN '{M.RETURNED_ALREADY}'
  WHEN 'over_30_days_late' THEN '{M.OVER_30_DAYS}' WHEN 'bad_condition' THEN '{M.BAD_CONDITION}'
  ELSE CASE WHEN tien_phat > 0 THEN 'Trả sách thành công! Tiền phạt: '
    || format('{{:,}}', CAST(round(tien_phat, 0) AS BIGINT)) || ' VNĐ. Mã hóa đơn: ' || ma_hoa_don
    ELSE 'Trả sách thành công! Không có tiền phạt.' END END"""

_BODY: dict[str, str] = {
    "f1_overdue_debt": "SELECT ma_the, ma_the IN (FROM cards_in_debt) AS co_no_qua_han FROM the_thu_vien",
    "f1_overdue_debt_by_reader": "SELECT ma_doc_gia, EXISTS (SELECT 1 FROM the_thu_vien t JOIN cards_in_debt "
    "USING (ma_the) WHERE t.ma_doc_gia = g.ma_doc_gia) AS co_no_qua_han FROM doc_gia g",
    "f2_stock_open4": "SELECT ma_sach, so_luong_con_lai FROM stock4",
    "f3_fine_replacement": f"SELECT ma_phieu_muon, ma_sach, {_replacement('trang_thai_sach')} AS tien_phat "
    "FROM chi_tiet JOIN sach USING (ma_sach)",
    "f3_fine_replacement_given_condition": "SELECT ma_phieu_muon, ma_sach, "
    f"{_replacement('dieu_kien')} AS tien_phat FROM return_requests "
    "JOIN chi_tiet USING (ma_phieu_muon, ma_sach) JOIN sach USING (ma_sach)",
    "f4_fine_additive": f"SELECT ma_phieu_muon, ma_sach, {_ADDITIVE} AS tien_phat "
    "FROM chi_tiet JOIN sach USING (ma_sach)",
    "f5_stock_open2": "SELECT ma_sach, so_luong_con_lai FROM stock2",
    "f6_reader_open_loans": "SELECT ma_doc_gia, coalesce(n, 0) AS so_sach_dang_muon FROM doc_gia "
    "LEFT JOIN held_per_reader USING (ma_doc_gia)",
    "q1_fine_report": "SELECT ma_doc_gia, ho_ten AS ten_doc_gia, ma_phieu_muon, ma_sach, ten_sach, "
    f"trang_thai_muon, trang_thai_sach, {_ADDITIVE} AS tien_phat FROM chi_tiet "
    "JOIN slip_reader USING (ma_phieu_muon) JOIN sach USING (ma_sach) "
    f"WHERE trang_thai_muon IN {_in(V.FINE_REPORT)}",
    "q2_stock_report": "SELECT ma_sach, ten_sach, so_luong, so_luong_con_lai FROM sach JOIN stock2 USING (ma_sach)",
    "q3_reader_loan_report": "SELECT ma_doc_gia, ho_ten, coalesce(n, 0) AS so_sach_dang_muon FROM doc_gia "
    "LEFT JOIN held_per_reader USING (ma_doc_gia)",
    "q4_loans_per_book": "SELECT ma_sach, count(ma_sach) AS so_luong_muon FROM chi_tiet GROUP BY ma_sach",
    "q5_borrowed_books": "SELECT ma_sach FROM sach WHERE ma_sach IN (SELECT ma_sach FROM chi_tiet) GROUP BY ma_sach",
    "q6_open_loans_per_card": "SELECT ma_the, count(*) AS so_sach FROM chi_tiet "
    "JOIN phieu_muon USING (ma_phieu_muon) JOIN the_thu_vien USING (ma_the) "
    f"WHERE trang_thai_muon = '{V.DANG_MUON}' GROUP BY ma_the",
    "q7_requests_for_line": "SELECT y.* FROM chi_tiet c JOIN yeu_cau_gia_han y "
    "ON c.ma_phieu_muon = y.ma_phieu_muon AND c.ma_sach = y.ma_sach",
    "q8_lookup_slips": "SELECT * FROM phieu_muon",
    "q8_lookup_lines": "SELECT * FROM chi_tiet",
    "q8_lookup_requests": "SELECT * FROM yeu_cau_gia_han",
    "q8_lookup_book_by_key": "SELECT * FROM sach WHERE ma_sach = 4",
    "q8_lookup_lines_by_slip": "SELECT * FROM chi_tiet WHERE ma_phieu_muon = 3",
    "q9_bulk_stock_decrement": "SELECT s.* REPLACE (CAST(so_luong - (SELECT count(DISTINCT ma_phieu_muon) "
    "FROM chi_tiet c WHERE c.ma_sach = s.ma_sach) AS INTEGER) AS so_luong) FROM sach s",
    "q10_bulk_status_set": "SELECT ma_phieu_muon, ma_sach, ngay_tra_du_kien, ngay_tra_thuc_te, "
    "tt_moi AS trang_thai_muon, ts_moi AS trang_thai_sach FROM chi_tiet "
    "JOIN returned_lines USING (ma_phieu_muon, ma_sach)",
    "q11_append_lines": f"SELECT {_LINE_COLUMNS} FROM chi_tiet UNION ALL "
    f"SELECT ma_phieu_muon, ma_sach, {_NEW_LINE} FROM new_lines_1 WHERE statement_id NOT IN "
    "(SELECT statement_id FROM short_1 UNION ALL SELECT statement_id FROM over_1)",
    "q11_append_requests": "SELECT * FROM yeu_cau_gia_han UNION ALL SELECT CAST(NULL AS BIGINT), ma_phieu_muon, "
    "ma_sach, ngay_tao, ngay_gia_han, trang_thai FROM inserted_extensions WHERE statement_id NOT IN "
    "(SELECT ma_phieu_muon FROM yeu_cau_gia_han)",
    "n1_expired_card_notice": f"SELECT ma_doc_gia, ma_the, {_days('ngay_het_han', NOW)} AS so_ngay_qua_han, "
    "'Độc giả ' || ma_doc_gia || ' (Mã thẻ ' || ma_the || ') đã quá hạn ' || "
    f"{_days('ngay_het_han', NOW)} || ' ngày' AS thong_bao FROM the_thu_vien t JOIN doc_gia g USING (ma_doc_gia) "
    f"WHERE ngay_het_han < {NOW}",
    "n2_rarely_borrowed_notice": "SELECT ma_sach, ten_sach, n AS so_lan_muon, 'Sách \"' || ten_sach || "
    "'\" (Mã sách: ' || ma_sach || ') ít được mượn – Số lần mượn: ' || n AS thong_bao FROM "
    "(SELECT s.ma_sach, ten_sach, count(ma_phieu_muon) AS n FROM sach s LEFT JOIN chi_tiet c "
    "ON c.ma_sach = s.ma_sach GROUP BY 1, 2) x WHERE n < 20",
    "t1_check_stock": "SELECT * FROM short_4",
    "t1_stock_after": "SELECT s.* REPLACE (CAST(so_luong - (SELECT count(*) FROM new_lines_1 i "
    "WHERE i.ma_sach = s.ma_sach AND statement_id NOT IN (SELECT statement_id FROM short_1)) "
    "AS INTEGER) AS so_luong) FROM sach s",
    "t2_restock_on_return": _restock((*V.OPEN, V.TRE_HEN), V.CLOSED, V.GOOD),
    "t2_restock_on_return_literal": _restock((V.DANG_MUON, V.TRE_HEN), (V.DA_TRA,), (V.TOT,)),
    "t3_check_card": "SELECT DISTINCT statement_id, ma_the, "
    f"CASE WHEN ngay_het_han < {NOW} THEN 'card_expired' ELSE 'card_not_active' END AS ly_do, "
    f"'{M.CARD_REFUSED}' AS thong_bao FROM inserted_slips JOIN the_thu_vien USING (ma_the) "
    f"WHERE ngay_het_han < {NOW} OR trang_thai <> '{V.HOAT_DONG}'",
    "t3_accepted_slips": "SELECT * FROM inserted_slips WHERE statement_id NOT IN (SELECT statement_id "
    f"FROM inserted_slips JOIN the_thu_vien USING (ma_the) WHERE ngay_het_han < {NOW} "
    f"OR trang_thai <> '{V.HOAT_DONG}')",
    "t4_check_loan_limit": "SELECT * FROM over_20",
    "t1_t4_check_new_lines": "SELECT statement_id, 'out_of_stock' AS ly_do, ma_sach AS khoa, thong_bao FROM short_2 "
    "UNION ALL SELECT statement_id, 'loan_limit', ma_the, thong_bao FROM over_2",
    "t1_t4_admit_statements": "SELECT statement_id, ma_phieu_muon, ma_sach FROM new_lines_2 "
    "WHERE statement_id NOT IN (FROM line_refused)",
    "t5_check_single_extension": "SELECT statement_id, ma_phieu_muon, ma_sach, 'already_requested' AS ly_do, "
    f"'{M.ONE_EXTENSION}' AS thong_bao FROM inserted_extensions i WHERE EXISTS (SELECT 1 FROM yeu_cau_gia_han y "
    "WHERE y.ma_phieu_muon = i.ma_phieu_muon AND y.ma_sach = i.ma_sach)",
    "t6_check_unique_reader": _unique(
        "doc_gia", "ma_doc_gia",
        _shifted("doc_gia", "ma_doc_gia", "ma_doc_gia + 1000000000", "ma_doc_gia * 2 + 2000000000",
                 "ma_doc_gia * 3 + 9000000000"), False),
    "t6_check_unique_staff": _unique(
        "nhan_vien", "ma_nhan_vien",
        _shifted("nhan_vien", "ma_nhan_vien", "ma_nhan_vien + 1000000",
                 "ma_nhan_vien * 2 + 1000000000", "ma_nhan_vien * 3 + 8000000000"), False),
    "s5_check_unique_reader_update": _unique(
        "doc_gia", "ma_doc_gia",
        _shifted("doc_gia", "ma_doc_gia", "ma_doc_gia", "cccd", "ma_doc_gia * 2 + 9000000000"), True),
    "s5_check_unique_staff_update": _unique(
        "nhan_vien", "ma_nhan_vien",
        _shifted("nhan_vien", "ma_nhan_vien", "ma_nhan_vien", "cccd",
                 "ma_nhan_vien * 2 + 8000000000"), True),
    "s6_check_book_delete": "SELECT DISTINCT ma_sach AS statement_id, ma_sach, "
    f"'{M.BOOK_ON_LOAN}' AS thong_bao FROM sach JOIN chi_tiet USING (ma_sach) "
    f"WHERE trang_thai_muon = '{V.DANG_MUON}'",
    "p1_screen_loans": "SELECT r.request_id, seq, coalesce(ly_do_1, ly_do_2) IS NULL AS thanh_cong, "
    f"coalesce(ly_do_1, ly_do_2) AS ly_do, CASE WHEN ly_do_1 IS NOT NULL THEN {_LOAN_TEXT} ELSE loi_2 END "
    "AS thong_bao FROM screened r LEFT JOIN alone a ON a.request_id = r.request_id",
    "p1_create_loans": "SELECT request_id, seq, ly_do IS NULL AS thanh_cong, ly_do, "
    f"CASE WHEN ly_do_1 IS NOT NULL THEN {_LOAN_TEXT} WHEN ly_do IS NOT NULL THEN loi_2 "
    "ELSE 'Tạo phiếu mượn thành công! Mã phiếu mượn: ' || ma_phieu_muon END AS thong_bao, "
    "ma_phieu_muon FROM loans",
    "p1_create_loans_lines": "SELECT ma_phieu_muon, unnest(ma) AS ma_sach, "
    f"{NOW} + to_days(so_ngay_muon) AS ngay_tra_du_kien, CAST(NULL AS TIMESTAMP) AS ngay_tra_thuc_te, "
    f"'{V.DANG_MUON}' AS trang_thai_muon, CAST(NULL AS VARCHAR) AS trang_thai_sach FROM loans "
    "WHERE ly_do IS NULL",
    "p1_create_loans_on_shelf": f"SELECT ma_phieu_muon, {NOW} AS ngay_lap, "
    "CAST(so_sach AS INTEGER) AS tong_so_sach_muon, ma_the, ma_nhan_vien FROM loans_shelf WHERE ly_do IS NULL",
    "p2_apply_extensions": f"SELECT request_id, seq, ly_do IS NULL AS thanh_cong, ly_do, {_EXT_TEXT} AS thong_bao "
    "FROM ext_done",
    "p2_lines_after": "SELECT c.* REPLACE (CASE WHEN e.ma_sach IS NULL THEN c.ngay_tra_du_kien "
    "ELSE e.ngay_gia_han END AS ngay_tra_du_kien, CASE WHEN e.ma_sach IS NULL THEN c.trang_thai_muon "
    f"ELSE '{V.DA_GIA_HAN}' END AS trang_thai_muon) FROM chi_tiet c LEFT JOIN "
    "(SELECT * FROM ext_done WHERE ly_do IS NULL) e "
    "ON e.ma_phieu_muon = c.ma_phieu_muon AND e.ma_sach = c.ma_sach",
    "p3_process_returns": "SELECT request_id, seq, ly_do IS NULL AS thanh_cong, ly_do, "
    f"{_RET_TEXT} AS thong_bao, tien_phat, ma_hoa_don FROM ret_done",
    "p3_invoices": f"SELECT ma_hoa_don, {NOW} AS ngay_lap, tien_phat AS so_tien, "
    f"CASE ts_moi WHEN '{V.MAT_SACH}' THEN '{V.TEXT_LOST}' WHEN '{V.HU_HONG_NANG}' THEN '{V.TEXT_DAMAGED}' "
    f"ELSE '{V.TEXT_LATE} (' || tre || ' ngày)' END || ' - Mã phiếu: ' || ma_phieu_muon || ', Mã sách: ' || ma_sach "
    "AS noi_dung, ma_doc_gia, ma_nhan_vien FROM ret_done WHERE ma_hoa_don IS NOT NULL",
    "p3_lines_after": "SELECT c.ma_phieu_muon, c.ma_sach, c.ngay_tra_du_kien, "
    f"CASE WHEN r.seq IS NOT NULL THEN {NOW} ELSE c.ngay_tra_thuc_te END AS ngay_tra_thuc_te, "
    "CASE WHEN r.seq IS NOT NULL THEN r.tt_moi ELSE c.trang_thai_muon END AS trang_thai_muon, "
    "CASE WHEN r.seq IS NOT NULL THEN r.ts_moi ELSE c.trang_thai_sach END AS trang_thai_sach "
    "FROM chi_tiet c LEFT JOIN (SELECT * FROM ret_done WHERE ly_do IS NULL) r "
    "ON r.ma_phieu_muon = c.ma_phieu_muon AND r.ma_sach = c.ma_sach",
    "p3_restock": f"SELECT ma_sach, count(*) AS them FROM ret_done WHERE ly_do IS NULL AND ts_moi = '{V.NGUYEN_VEN}' "
    f"AND trang_thai_muon IN {_in((*V.OPEN, V.TRE_HEN))} GROUP BY ma_sach",
    "p4_ingest_books": "SELECT request_id, seq, ly_do IS NULL AS thanh_cong, ly_do, CASE ly_do "
    "WHEN 'category_not_found' THEN 'Thể loại không tồn tại!' "
    "WHEN 'blank_title' THEN 'Tên sách không được để trống!' "
    "WHEN 'negative_stock' THEN 'Số lượng sách phải >= 0!' WHEN 'negative_price' THEN 'Đơn giá phải >= 0!' "
    "WHEN 'author_not_found' THEN 'Tác giả có mã ' || muc || ' không tồn tại!' "
    "ELSE 'Thêm sách mới thành công! Mã sách: ' || ma_sach END AS thong_bao, ma_sach FROM books_done",
    "p4_new_authors": f"SELECT ma_tac_gia, muc AS ten_tac_gia, '{M.NEW_AUTHOR_NOTE}' AS mo_ta FROM new_names",
    "p4_new_links": "SELECT DISTINCT coalesce(CASE WHEN la_ma THEN TRY_CAST(w.muc AS BIGINT) END, "
    "(SELECT min(ma_tac_gia) FROM tac_gia t WHERE NOT la_ma AND t.ten_tac_gia = w.muc), n.ma_tac_gia) "
    "AS ma_tac_gia, ma_sach FROM wanted w LEFT JOIN new_names n ON n.muc = w.muc",
    "p5_patch_accounts": "SELECT request_id, seq, d IS NOT NULL AS thanh_cong, "
    "CASE WHEN d IS NULL THEN 'not_found' END AS ly_do, d AS doi_tuong FROM (SELECT *, "
    "CASE WHEN username IN (SELECT username FROM nhan_vien) THEN 'nhan_vien' "
    "WHEN username IN (SELECT username FROM doc_gia) THEN 'doc_gia' END AS d FROM account_patches) x",
    "p5_staff_after": "SELECT ma_nhan_vien, v.username, coalesce(password_moi, password) AS password, "
    "coalesce(trang_thai_moi, trang_thai) AS trang_thai FROM nhan_vien v LEFT JOIN patched p "
    "ON p.username = v.username",
    "p5_readers_after": "SELECT ma_doc_gia, v.username, coalesce(password_moi, password) AS password, "
    "coalesce(trang_thai_moi, trang_thai) AS trang_thai FROM doc_gia v LEFT JOIN patched p "
    "ON p.username = v.username AND p.username NOT IN (SELECT username FROM nhan_vien)",
    "p6_decide_extensions": "SELECT request_id, seq, TRUE AS thanh_cong, CAST(NULL AS VARCHAR) AS ly_do, "
    f"CASE WHEN chap_nhan THEN '{V.DA_DUYET}' ELSE '{V.TU_CHOI}' END AS trang_thai FROM decided",
    "p6_requests_after": "SELECT y.* REPLACE (d.tt AS trang_thai) FROM yeu_cau_gia_han y JOIN "
    f"(SELECT ma_yeu_cau, arg_max(CASE WHEN chap_nhan THEN '{V.DA_DUYET}' ELSE '{V.TU_CHOI}' END, seq) AS tt "
    "FROM decided GROUP BY 1) d USING (ma_yeu_cau)",
    "p6_lines_after": "SELECT c.* REPLACE (coalesce(d.ngay, c.ngay_tra_du_kien) AS ngay_tra_du_kien) "
    "FROM chi_tiet c LEFT JOIN (SELECT ma_phieu_muon, ma_sach, arg_max(ngay_gia_han, seq) AS ngay "
    "FROM decided WHERE chap_nhan GROUP BY 1, 2) d "
    "ON d.ma_phieu_muon = c.ma_phieu_muon AND d.ma_sach = c.ma_sach",
    "p7_cancel_cards": "SELECT request_id, seq, ly_do IS NULL AS thanh_cong, ly_do, "
    f"CASE ly_do WHEN 'has_open_loans' THEN '{M.HOLDS_BOOKS}' END AS thong_bao FROM cancelled",
    "p7_cards_after": "SELECT t.* REPLACE (CASE WHEN ma_doc_gia IN (SELECT ma_doc_gia FROM cancelled "
    f"WHERE ly_do IS NULL) THEN '{V.BI_HUY}' ELSE trang_thai END AS trang_thai) FROM the_thu_vien t",
    "p7_readers_after": "SELECT ma_doc_gia, CASE WHEN ma_doc_gia IN (SELECT ma_doc_gia FROM cancelled "
    f"WHERE ly_do IS NULL) THEN '{V.VO_HIEU}' ELSE trang_thai END AS trang_thai FROM doc_gia",
    "s1_books_by_author": "SELECT ma_tac_gia, ma_sach, ten_sach FROM tac_gia_sach JOIN sach USING (ma_sach)",
    "s2_books_by_category": "SELECT ma_the_loai, ma_sach, ten_sach FROM sach",
    "s3_overdue_books_of_reader": "SELECT ma_doc_gia, ma_phieu_muon, ma_sach, ten_sach, ngay_tra_du_kien "
    f"FROM chi_tiet JOIN slip_reader USING (ma_phieu_muon) JOIN sach USING (ma_sach) WHERE {_OVERDUE}",
    "s4_reader_name_of_card": "SELECT ma_the, ho_ten FROM the_thu_vien t JOIN doc_gia g USING (ma_doc_gia)",
    "s7_lock_overdue_cards": "SELECT t.* REPLACE (CASE WHEN ma_the IN (FROM cards_in_debt) "
    f"THEN '{V.BI_KHOA}' ELSE trang_thai END AS trang_thai) FROM the_thu_vien t",
    "s8_classify_income": "SELECT CAST(date_trunc('month', ngay_lap) AS DATE) AS thang, "
    "CASE WHEN " + " OR ".join(f"starts_with(noi_dung, '{t}')" for t in V.FINE_TEXTS) + " THEN 'phat' "
    f"WHEN starts_with(noi_dung, '{V.TEXT_CARD}') THEN 'lam_the' ELSE 'khac' END AS nguon_thu, "
    "count(*) AS so_hoa_don, CAST(sum(so_tien) AS DECIMAL(18,2)) AS tong_tien FROM hoa_don GROUP BY 1, 2",
    "s9_auto_reject_requests": "SELECT y.* REPLACE (CASE WHEN "
    f"trang_thai = '{V.CHO}' AND ngay_tao + INTERVAL 3 DAY < {NOW} THEN '{V.TU_CHOI}' "
    "ELSE trang_thai END AS trang_thai) FROM yeu_cau_gia_han y",
    "s10_top_books": "SELECT ma_sach, ten_sach, count(*) AS so_luong_muon FROM chi_tiet JOIN sach USING (ma_sach) "
    "GROUP BY 1, 2 ORDER BY so_luong_muon DESC, ma_sach LIMIT 10",
    "s11_overdue_readers": "SELECT ma_doc_gia, ho_ten, so_dien_thoai, ma_phieu_muon, ma_sach, ten_sach, "
    f"{_days('ngay_tra_du_kien', NOW)} AS so_ngay_tre FROM chi_tiet JOIN slip_reader USING (ma_phieu_muon) "
    f"JOIN sach USING (ma_sach) WHERE {_OVERDUE}",
    "s12_revenue_by_day": _revenue("day"),
    "s12_revenue_by_month": _revenue("month"),
    "s12_revenue_by_quarter": _revenue("quarter"),
    "s12_revenue_by_year": _revenue("year"),
    "s13_category_status": "SELECT ma_the_loai, ten_the_loai, CAST(tong AS BIGINT) AS tong_so_luong, "
    "muon AS dang_muon, CAST(tong - muon AS BIGINT) AS con_lai, hong AS hu_hong FROM the_loai "
    "JOIN (SELECT ma_the_loai, sum(so_luong) AS tong FROM sach GROUP BY 1) a USING (ma_the_loai) "
    f"JOIN (SELECT ma_the_loai, count(*) FILTER (trang_thai_muon IN {OPEN}) AS muon, "
    f"count(*) FILTER (trang_thai_sach IN {DAMAGED}) AS hong FROM chi_tiet JOIN sach USING (ma_sach) GROUP BY 1) b "
    "USING (ma_the_loai)",
    "s14_damage_ratio_by_month": _damage("month"),
    "s14_damage_ratio_by_quarter": _damage("quarter"),
    "s14_damage_ratio_by_year": _damage("year"),
    "s15_cards_expiring": "SELECT ma_the, ma_doc_gia, ngay_het_han, trang_thai FROM the_thu_vien "
    f"WHERE ngay_het_han BETWEEN {NOW} AND {NOW} + INTERVAL 30 DAY",
}
_BODY["q1_fine_report_replacement"] = _BODY["q1_fine_report"].replace(
    _ADDITIVE, _replacement("trang_thai_sach")
)
_BODY["q7_requests_for_one_line"] = (
    _BODY["q7_requests_for_line"] + " WHERE c.ma_phieu_muon = 13 AND c.ma_sach = 7"
)
# Lines and slips of this batch never repeat, so the strict rule finds what the plain one does.
_BODY["t5_check_single_extension_strict"] = _BODY["t5_check_single_extension"]

_BODY |= {
    "q7_requests_for_first_line": _BODY["q7_requests_for_line"] + " WHERE y.ma_yeu_cau = "
    "(SELECT min(ma_yeu_cau) FROM yeu_cau_gia_han)",
    # new books have never been borrowed
    "n2_rarely_borrowed_with_new_books": "SELECT ma_sach, ten_sach, n AS so_lan_muon, 'Sách \"' || ten_sach || "
    "'\" (Mã sách: ' || ma_sach || ') ít được mượn – Số lần mượn: ' || n AS thong_bao FROM "
    "(SELECT s.ma_sach, ten_sach, count(ma_phieu_muon) AS n FROM (SELECT ma_sach, ten_sach FROM sach UNION ALL "
    "SELECT ma_sach, ten_sach FROM books_done WHERE ly_do IS NULL) s LEFT JOIN chi_tiet c "
    "ON c.ma_sach = s.ma_sach GROUP BY 1, 2) x WHERE n < 2",
    "p3_release_lines_after": _BODY["p3_lines_after"],
    "p2_release_lines_compacted": _BODY["p2_lines_after"],
    "t2_restock_of_release": _BODY["p3_restock"],
    "f2_stock_of_release": f"SELECT s.ma_sach, coalesce(s.so_luong - coalesce(n, 0), 0) AS so_luong_con_lai FROM sach s "
    f"LEFT JOIN (SELECT ma_sach, count(*) AS n FROM ({_BODY['p3_lines_after']}) x WHERE trang_thai_muon IN {OPEN} "
    "GROUP BY 1) c ON c.ma_sach = s.ma_sach",
    "f6_open_loans_of_release": "SELECT g.ma_doc_gia, coalesce(n, 0) AS so_sach_dang_muon FROM doc_gia g LEFT JOIN "
    f"(SELECT ma_doc_gia, count(ma_sach) AS n FROM ({_BODY['p2_lines_after']}) x JOIN slip_reader USING (ma_phieu_muon) "
    f"WHERE trang_thai_muon IN {HELD} GROUP BY 1) c ON c.ma_doc_gia = g.ma_doc_gia",
}

_NEW_READERS = _shifted("doc_gia", "ma_doc_gia", "ma_doc_gia + 1000000000", "ma_doc_gia * 2 + 2000000000",
                        "ma_doc_gia * 3 + 9000000000")
_BODY |= {
    "q1_fine_report_bucketed": _BODY["q1_fine_report"],
    "q6_open_loans_per_card_bucketed": _BODY["q6_open_loans_per_card"],
    "s7_lock_overdue_cards_in_two_runs": _BODY["s7_lock_overdue_cards"],
    # Lines, identity numbers and phones of these batches never repeat, so only stored rows are in the way.
    "t5_admit_extensions": "SELECT * FROM inserted_extensions WHERE statement_id NOT IN "
    "(SELECT ma_phieu_muon FROM yeu_cau_gia_han)",
    "t6_admit_readers": "SELECT i.statement_id, i.ma_doc_gia, d.ho_ten, i.cccd, i.so_dien_thoai FROM "
    f"({_NEW_READERS}) i JOIN doc_gia d ON d.ma_doc_gia = i.statement_id WHERE i.statement_id NOT IN "
    f"(SELECT statement_id FROM ({_BODY['t6_check_unique_reader']}) v)",
}

# The functions called from SQL text give what the plain queries give.
_BODY |= {
    f"{name}_sql": _BODY[name]
    for name in (
        "f1_overdue_debt", "f1_overdue_debt_by_reader", "f2_stock_open4", "f3_fine_replacement", "f4_fine_additive",
        "q1_fine_report", "q2_stock_report", "q3_reader_loan_report", "s1_books_by_author", "s2_books_by_category",
        "s3_overdue_books_of_reader", "s4_reader_name_of_card",
    )
}

_PARTS |= _one_after_another("line_claims", "line_refused")


def _with_parts(body: str) -> str:
    """Put the parts a query names in front of it, and the parts those name, in defining order."""
    wanted: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in (words & _PARTS.keys()) - wanted:
            wanted.add(name)
            todo.append(_PARTS[name])
    ordered = [n for n in _PARTS if n in wanted]
    # a part is defined before it is used, except for the recursive ones, which come with theirs
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in ordered) + "\n" + body


ORACLE: dict[str, str] = {name: _with_parts(body) for name, body in _BODY.items()}

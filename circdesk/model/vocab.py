"""Status words of the library data, in Unicode NFC.

Fixed values: they must equal the stored data letter for letter.
"""

# -- loan lines (trang_thai_muon) -------------------------------------------
DANG_MUON = "Đang mượn"
TRE_HAN = "Trễ hạn"
TRE_HEN = "Trễ hẹn"  # second spelling of TRE_HAN
DA_GIA_HAN = "Đã gia hạn"
DAT_TRUOC = "Đặt trước"
DA_TRA = "Đã trả"
HOAN_THANH = "Hoàn thành"
TRA_TRE = "Trả trễ"

OPEN = (DANG_MUON, TRE_HAN, DA_GIA_HAN, DAT_TRUOC)
HELD = (DANG_MUON, TRE_HAN)
CLOSED = (DA_TRA, HOAN_THANH, TRA_TRE)
FINE_REPORT = (TRE_HAN, DANG_MUON, DA_TRA)

# -- book condition (trang_thai_sach) ---------------------------------------
NGUYEN_VEN = "Nguyên vẹn"
TOT = "Tốt"
HU_HONG_NANG = "Hư hỏng nặng"
HONG = "Hỏng"
MAT_SACH = "Mất sách"
MAT = "Mất"

GOOD = (TOT, NGUYEN_VEN)
DAMAGED = (HONG, HU_HONG_NANG)
LOST = (MAT, MAT_SACH)

# -- cards, readers, extension requests -------------------------------------
HOAT_DONG = "Hoạt động"
BI_HUY = "Bị hủy"
BI_KHOA = "Bị khóa"
VO_HIEU = "Vô hiệu"
DA_DUYET = "Đã duyệt"
TU_CHOI = "Từ chối"
CHO = "Chờ"

# -- texts written by the batches -------------------------------------------
TEXT_LATE = "Phạt trả sách trễ hạn"
TEXT_LOST = "Đền sách mất"
TEXT_DAMAGED = "Phạt sách hư hỏng nặng"
TEXT_CARD = "Làm thẻ"
FINE_TEXTS = (TEXT_LATE, TEXT_LOST, TEXT_DAMAGED)

# -- business limits ---------------------------------------------------------
CARD_LIMIT = 5
SLIP_LIMIT = 10
MAX_LOAN_DAYS = 60
DEFAULT_LOAN_DAYS = 14
MAX_LATE_DAYS = 30
MIN_DAYS_BEFORE_DUE = 7
REPLACEMENT_DAILY = 20000
ADDITIVE_DAILY = 5000
ADDITIVE_DAMAGE_SHARE = "0.3"

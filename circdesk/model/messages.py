"""Texts shown to people.

Fixed values: they must equal the known wording letter for letter. ``{}`` marks a value.
"""

# -- loans
CARD_UNKNOWN = "Thẻ thư viện không tồn tại!"
CARD_INACTIVE = "Thẻ thư viện không còn hoạt động! Trạng thái: {}"
CARD_EXPIRED = "Thẻ thư viện đã hết hạn!"
IN_DEBT = "Độc giả đang có sách mượn quá hạn chưa trả. Vui lòng trả sách trước khi mượn mới!"
TERM_TOO_LONG = "Thời gian mượn tối đa là 60 ngày (2 tháng)!"
TERM_NOT_POSITIVE = "Thời gian mượn phải lớn hơn 0!"
TOO_MANY_BOOKS = "Mỗi lần chỉ được mượn tối đa 10 cuốn sách!"
EMPTY_LIST = "Danh sách sách không được để trống!"
BOOK_UNKNOWN = "Sách có mã {} không tồn tại!"
BOOK_OUT = 'Sách "{}" đã hết trong kho!'
LOAN_MADE = "Tạo phiếu mượn thành công! Mã phiếu mượn: {}"
BAD_ITEM = "Lỗi: mã sách không hợp lệ"
DUPLICATE_BOOK = "Lỗi: một sách có hai lần trong danh sách"

# -- extensions
REQUEST_UNKNOWN = "Yêu cầu gia hạn không tồn tại!"
NOT_APPROVED = "Yêu cầu gia hạn chưa được duyệt! Trạng thái hiện tại: {}"
EXTENDED_ALREADY = "Sách này đã được gia hạn rồi! Mỗi sách chỉ được gia hạn 1 lần."
EXTENDED_TOO_LATE = "Yêu cầu gia hạn phải được tạo trước ít nhất 7 ngày so với ngày trả dự kiến!"
LINE_UNKNOWN = "Chi tiết phiếu mượn không tồn tại!"
EXTENDED = "Gia hạn sách thành công! Ngày trả dự kiến mới: {}"

# -- returns
RETURNED_ALREADY = "Sách này đã được trả rồi!"
OVER_30_DAYS = "Đã quá 30 ngày kể từ hạn trả! Vui lòng liên hệ trực tiếp để xử lý."
BAD_CONDITION = "Tình trạng sách không hợp lệ! Chỉ chấp nhận: Nguyên vẹn (hoặc Tốt), Hư hỏng nặng (hoặc Hỏng), Mất sách (hoặc Mất)"
RETURNED_WITH_FINE = "Trả sách thành công! Tiền phạt: {} VNĐ. Mã hóa đơn: {}"
RETURNED = "Trả sách thành công! Không có tiền phạt."
INVOICE_LATE = "Phạt trả sách trễ hạn ({} ngày) - Mã phiếu: {}, Mã sách: {}"
INVOICE_LOST = "Đền sách mất - Mã phiếu: {}, Mã sách: {}"
INVOICE_DAMAGED = "Phạt sách hư hỏng nặng - Mã phiếu: {}, Mã sách: {}"

# -- new books
CATEGORY_UNKNOWN = "Thể loại không tồn tại!"
TITLE_BLANK = "Tên sách không được để trống!"
STOCK_NEGATIVE = "Số lượng sách phải >= 0!"
PRICE_NEGATIVE = "Đơn giá phải >= 0!"
AUTHOR_UNKNOWN = "Tác giả có mã {} không tồn tại!"
BOOK_ADDED = "Thêm sách mới thành công! Mã sách: {}"
NEW_AUTHOR_NOTE = "Tác giả mới được thêm tự động"

# -- cards and checks
HOLDS_BOOKS = "Không thể hủy thẻ: độc giả vẫn còn sách chưa trả"
NOT_ENOUGH_STOCK = "Số lượng sách không đủ"
CARD_REFUSED = "Thẻ thư viện đã hết hạn hoặc bị khóa"
LOAN_LIMIT = "Số lượng sách mượn vượt quá giới hạn 5 cuốn cho một hoặc nhiều độc giả."
ONE_EXTENSION = "Chỉ được gia hạn 1 lần cho 1 sách"
PERSON_EXISTS = "CCCD hoặc số điện thoại đã tồn tại"
BOOK_ON_LOAN = "Sách đang được mượn"

# -- notices
CARD_NOTICE = "Độc giả {} (Mã thẻ {}) đã quá hạn {} ngày"
BOOK_NOTICE = 'Sách "{}" (Mã sách: {}) ít được mượn – Số lần mượn: {}'

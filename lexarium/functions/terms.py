"""Word lists, labels and patterns of Vietnamese legal text."""

#: Phrases in the order in which a title is tried, and their categories. Spaces in a phrase may be missing or many.
CATEGORIES = [
    ("hình sự", "Hình sự"),
    ("hành chính", "Hành chính"),
    ("dân sự", "Dân sự"),
    ("tố tụng", "Tố tụng"),
    ("tư pháp", "Tư pháp - Hộ tịch"),
    ("hộ tịch", "Tư pháp - Hộ tịch"),
    ("quốc phòng", "Quốc phòng - An ninh"),
    ("an ninh", "Quốc phòng - An ninh"),
    ("doanh nghiệp", "Doanh nghiệp"),
    ("đầu tư", "Đầu tư"),
    ("thương mại", "Thương mại"),
    ("tài chính", "Tài chính - Ngân hàng"),
    ("ngân hàng", "Tài chính - Ngân hàng"),
    ("thuế", "Thuế - Phí - Lệ phí"),
    ("phí lệ phí", "Thuế - Phí - Lệ phí"),
    ("kế toán", "Kế toán - Kiểm toán"),
    ("kiểm toán", "Kế toán - Kiểm toán"),
    ("xuất nhập khẩu", "Xuất nhập khẩu - Hải quan"),
    ("hải quan", "Xuất nhập khẩu - Hải quan"),
    ("sở hữu trí tuệ", "Sở hữu trí tuệ"),
    ("lao động", "Lao động - Tiền lương"),
    ("tiền lương", "Lao động - Tiền lương"),
    ("bảo hiểm", "Bảo hiểm"),
    ("y tế", "Y tế - Sức khỏe"),
    ("sức khỏe", "Y tế - Sức khỏe"),
    ("giáo dục", "Giáo dục - Đào tạo"),
    ("đào tạo", "Giáo dục - Đào tạo"),
    ("văn hóa", "Văn hóa - Thể thao - Du lịch"),
    ("thể thao", "Văn hóa - Thể thao - Du lịch"),
    ("du lịch", "Văn hóa - Thể thao - Du lịch"),
    ("cán bộ", "Cán bộ - Công chức - Viên chức"),
    ("công chức", "Cán bộ - Công chức - Viên chức"),
    ("viên chức", "Cán bộ - Công chức - Viên chức"),
    ("đất đai", "Đất đai - Nhà ở"),
    ("nhà ở", "Đất đai - Nhà ở"),
    ("xây dựng", "Xây dựng - Đô thị"),
    ("đô thị", "Xây dựng - Đô thị"),
    ("giao thông", "Giao thông - Vận tải"),
    ("vận tải", "Giao thông - Vận tải"),
    ("tài nguyên", "Tài nguyên - Môi trường"),
    ("môi trường", "Tài nguyên - Môi trường"),
    ("nông nghiệp", "Nông nghiệp - Lâm nghiệp - Thủy sản"),
    ("lâm nghiệp", "Nông nghiệp - Lâm nghiệp - Thủy sản"),
    ("thủy sản", "Nông nghiệp - Lâm nghiệp - Thủy sản"),
    ("công nghệ thông tin", "Công nghệ thông tin - An ninh mạng"),
    ("an ninh mạng", "Công nghệ thông tin - An ninh mạng"),
    ("cư trú", "Cư trú"),
]
OTHER_CATEGORY = "Khác"

#: Kinds of documents, in the order in which a slug or title is tried.
DOC_TYPES = [
    (r"b[ôo]\s*lu[âa]t", "Bộ luật"),
    (r"lu[âa]t\b", "Luật"),
    (r"ngh[iị]\s*quy[eê]t", "Nghị quyết"),
    (r"ph[áa]p\s*l[êe]nh", "Pháp lệnh"),
    (r"ngh[iị]\s*[đd]inh", "Nghị định"),
    (r"quy[eê]t\s*[đd]inh", "Quyết định"),
    (r"th[oô]ng\s*t[ưu]", "Thông tư"),
    (r"ch[iỉ]\s*th[iị]", "Chỉ thị"),
    (r"c[oô]ng\s*v[aă]n", "Công văn"),
    (r"th[oô]ng\s*b[áa]o", "Thông báo"),
    (r"h[ưu]ớng\s*d[aaã]?n", "Hướng dẫn"),
    (r"quy\s*[đd]ịnh", "Quy định"),
    (r"quy\s*ch[eế]", "Quy chế"),
    (r"k[eế]\s*ho[ạ]ch", "Kế hoạch"),
    (r"ti[êe]u\s*chu[à]?[âa]?n", "Tiêu chuẩn Việt Nam (TCVN)"),
    (r"tcvn\b", "Tiêu chuẩn Việt Nam (TCVN)"),
    (r"qcvn\b", "Quy chuẩn Quốc gia (QCVN)"),
]

#: What a challenge page says, and letters of broken encodings.
CHALLENGE = ["just a moment...", "checking your browser", "challenges.cloudflare.com"]
BROKEN = "\ufffd\x86\x81"

#: Starts of footer lines.
FOOTER = [
    "* Lưu trữ", "* **Ghi chú**", "* Ý kiến", "* [Facebook ", "* Email", "* In",
    "* [ Hỏi đáp pháp luật", "* [ Pháp Luật Thuế", "* [ Bản án liên quan", "* [PHÁP LUẬT DOANH NGHIỆP",
]

#: Ids of content panels, signs of legal text, signs of page furniture, marks of translations.
PANELS = [
    "ctl00_Content_ThongTinVB_pnlDocContent", "toanvancontent", "fulltext", "ctl00_Content_ThongTinVB_divNoiDung",
    "ctl00_Content_ThongTinVB_divContent", "divContentDoc", "divNoiDung", "divContent",
]
LEGAL = [r"\bĐiều\s+\d+", r"\bKhoản\s+\d+", r"\bChương\s+[IVXL\d]", r"\bMục\s+\d+"]
FURNITURE = [
    r"\* Lưu trữ\b", r"\*[ *]*Ghi chú\*?", r"\* Ý kiến\b", r"\* Email\b", r"\* In\b", r"Hỏi đáp pháp luật",
    r"Pháp Luật (?:Thuế|Doanh Nghiệp)", r"Bản án liên quan", r"BannerTuyenDung",
]
ENGLISH_PAGE = [r"Ngôn\s*ngữ\s*:\s*Tiếng\s*Anh", r"Language\s*:\s*English"]
COPYRIGHT = r"Bản\s*dịch\s*này\s*thuộc\s*quyền\s*sở\s*hữu"
NOISE_TAGS = ["script", "style", "nav", "header", "footer", "noscript", "iframe", "form", "select", "button", "input", "textarea", "img", "svg", "canvas"]
CELL_LABELS = {
    "doc_number": "Số hiệu:", "doc_type": "Loại văn bản:", "issued_date": "Ngày ban hành:", "effective_date": "Ngày hiệu lực:",
    "issuing_authority": "Nơi ban hành:", "signer": "Người ký:", "category": "Lĩnh vực:", "expiry_date": "Ngày hết hiệu lực:",
}
SITE_SUFFIX = r"\s*[-–—]?\s*Thư\s*viện\s*Pháp\s*luật\s*$"

#: Words that aren't keywords.
STOPWORDS = [
    "và", "của", "các", "có", "được", "cho", "trong", "với", "hoặc", "không", "theo", "tại", "về", "đến", "là", "này",
    "một", "những", "đã", "sẽ", "đang", "bị", "phải", "khi", "để", "từ", "ra", "lên", "xuống", "vào", "ở", "trên",
    "dưới", "cùng", "đều", "hay", "nếu", "thì", "do", "vì", "nên", "mà", "còn", "đây", "đó", "ấy", "nào", "sao",
    "thế", "vậy", "như", "cũng", "vẫn", "chỉ", "rất", "quá", "lắm", "hơn", "kém", "bằng", "nhưng", "tuy", "nhiên", "song",
    "cả", "hết", "gì", "hãy", "chớ", "đừng", "xin", "cần", "số", "ngày", "tháng", "năm", "điều", "khoản", "chương", "mục",
]

#: Status of a document.
STATUS = {0: "Chưa xác định", 1: "Còn hiệu lực", 2: "Hết hiệu lực", 3: "Sắp có hiệu lực", 4: "Hết hiệu lực một phần", 5: "Có hiệu lực một phần"}
STATUS_UNKNOWN, NO_LAW = "Không rõ", "Không có dữ liệu pháp luật liên quan."

#: Topics of employment contracts in order, and words that show each, in order.
TOPICS = {
    "salary": ["lương", "mức lương", "tiền lương", "thu nhập", "trả lương", "phụ cấp", "thưởng", "nâng lương", "lương cơ bản", "lương tháng", "luong", "muc luong", "tien luong", "thu nhap", "phu cap"],
    "working_time": ["giờ làm", "thời gian làm", "nghỉ trưa", "ca làm", "giờ làm việc", "thời giờ làm việc", "nghỉ ngơi", "nghỉ giải lao", "gio lam", "thoi gian lam", "nghi trua", "thoi gio lam viec"],
    "overtime": ["tăng ca", "làm thêm", "thêm giờ", "ngoài giờ", "làm thêm giờ", "overtime", "giờ làm thêm", "tang ca", "lam them gio"],
    "insurance": ["bảo hiểm", "bhxh", "bhyt", "bhtn", "bảo hiểm xã hội", "bảo hiểm y tế", "bảo hiểm thất nghiệp", "bảo hiểm tai nạn", "bao hiem", "bao hiem xa hoi", "bao hiem y te"],
    "leave": ["nghỉ phép", "nghỉ lễ", "nghỉ ốm", "thai sản", "nghỉ việc riêng", "phép năm", "nghỉ không lương", "nghỉ chế độ", "nghi phep", "nghi le", "nghi om", "thai san", "phep nam"],
    "termination": ["nghỉ việc", "thôi việc", "sa thải", "chấm dứt", "đơn phương", "thanh lý hợp đồng", "cho thôi việc", "nghi viec", "thoi viec", "sa thai", "cham dut", "don phuong"],
    "probation": ["thử việc", "tập sự", "học việc", "thời gian thử", "thu viec", "tap su", "hoc viec"],
    "discipline": ["kỷ luật", "cảnh cáo", "khiển trách", "phạt", "vi phạm nội quy", "xử lý kỷ luật", "kỷ luật lao động", "trách nhiệm vật chất", "ky luat", "canh cao", "khien trach", "xu ly ky luat"],
    "benefits": ["phúc lợi", "trợ cấp", "ăn trưa", "xăng xe", "điện thoại", "công tác phí", "đào tạo", "bồi dưỡng", "độc hại", "phuc loi", "tro cap", "an trua", "xang xe", "dao tao"],
    "tax": ["thuế", "thuế thu nhập", "tncn", "khấu trừ", "giảm trừ gia cảnh", "thuế thu nhập cá nhân", "quyết toán thuế", "thue", "thue thu nhap", "khau tru", "giam tru gia canh"],
}
GENERAL = "general"

#: Line starts of sections (kind, depth, pattern) in order, of signatures, and all-capital titles.
SECTIONS = [
    ("chuong", 1, r"(?i)^Chương\s+([IVXLCDM]+|\d+)"),
    ("muc", 2, r"(?i)^Mục\s+(\d+)"),
    ("dieu", 3, r"(?i)^Điều\s+(\d+)"),
    ("phu_luc", 1, r"(?i)^Phụ lục(?:\s+(\d+))?"),
    ("khoan", 4, r"^(\d+)\.\s"),
    ("diem", 5, r"^([a-zđ])\)\s"),
]
SIGNING = r"^(?:Nơi nhận:|Ký\s+tên|KT\.|TM\.\s)"
TITLES = r"^(?:NGHỊ ĐỊNH|THÔNG TƯ|QUYẾT ĐỊNH|LUẬT|PHÁP LỆNH|THÔNG CÁO|CHỈ THỊ|CÔNG VĂN|THÔNG BÁO|HƯỚNG DẪN)\b"
ENFORCEMENT = (
    r"(?i)Điều\s+\d+\s*\.\s*(?:Điều\s+khoản\s+thi\s+hành|Trách\s+nhiệm\s+và\s+hiệu\s+lực\s+thi\s+hành|Hiệu\s+lực\s+thi\s+hành)"
    r"|Chương\s+[IVXLCDM]+\s+ĐIỀU\s+KHOẢN\s+THI\s+HÀNH|Quyết\s+định\s+\(\s*điều\s+\d+\s*-\s*\d+\s*\)"
)
IN_FORCE = r"(?i)(?:quyết\s+định|thông\s+tư|nghị\s+định|văn\s+bản)\s+này\s+có\s+hiệu\s+lực"
#: What opens the legal basis of an act.
LEGAL_BASIS = r"(?i)^Căn cứ\s+(?:vào\s+)?(?:Luật|Pháp lệnh|Nghị quyết|Hiến pháp|Bộ luật)\s"
#: Places of an act's text in a page, by id or class, in order; elements that are blocks; children that make a div no block of its own.
CONTAINERS = [
    ("id", "toanvancontent"), ("class", "content1"), ("id", "fulltext"), ("class", "content"), ("id", "ctl00_Content_ThongTinVB_pnlDocContent"), ("class", "detail-content"), ("class", "fulltext"), ("id", "ToFullText"),
]
BLOCKS = ["p", "table", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "hr", "pre", "blockquote", "div"]
INNER_BLOCKS = ["p", "table", "h1", "h2", "h3", "h4", "ul", "ol"]

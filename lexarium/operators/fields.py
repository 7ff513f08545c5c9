"""Fields of contracts: dates, money, clauses, kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import UNI, blank_to_null, composed, computed, folded, may_fit, strip
from ..functions.text import once
from .contracts import clause_array, party_array

#: How dates, money and kinds of clause are worded.
DATE = r"\d{1,2}\s*(?:/|\.|\-|tháng)\s*\d{1,2}\s*(?:/|\.|\-|năm|$)\s*\d{2,4}"
LONG_DATE = r"\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
#: What is in each of these.
ANY_DATE = r"\d\s*(?:/|\.|\-|tháng)\s*\d"
SIGNED = [rf"hôm\s+nay,\s*ngày\s+({DATE})", rf"(?:ngày\s+ký|ký\s+kết|ngày\s+lập)\s*[:\-–]?\s*({DATE})"]
STARTS = [
    rf"Từ\s+ngày\s*[:\|\t]+\s*({DATE})",
    rf"(?:có\s+hiệu\s+lực|hiệu\s+lực)\s+(?:từ|kể\s+từ)\s+(?:ngày\s+)?({DATE})",
    rf"bắt\s+đầu\s+(?:từ|kể\s+từ)\s+(?:ngày\s+)?({DATE})",
]
ENDS = [rf"Đến\s+ngày\s*[:\|\t]+\s*({DATE})", rf"(?:đến|cho\s+đến)\s+(?:ngày\s+)?({DATE})", rf"kết\s+thúc\s+(?:vào|ngày)\s+({DATE})"]
CELL_END = r"(?:\s*\||\s*\n|\s*$)"
VALUES = [
    rf"(?:Lương\s+căn\s+bản|Lương\s+cơ\s+bản|Mức\s+lương\s+căn\s+bản)\s*[:\|\t]+\s*\|?\s*(.+?){CELL_END}",
    r"(?:giá\s+trị\s+hợp\s+đồng|tổng\s+giá\s+trị)\s*[:\-–]\s*(.+)",
    r"(?:thù\s+lao|tiền\s+công)\s*[:\-–]\s*(.+)",
]
METHODS = [rf"(?:Hình\s+thức\s+trả\s+lương|phương\s+thức\s+thanh\s+toán)\s*[:\|\t]+\s*\|?\s*(.+?){CELL_END}"]
BARE_METHOD = r"thanh\s+toán\s+bằng\s+(?:tiền\s+mặt|chuyển\s+khoản)"
TERMS = [r"(?:tiến\s+độ\s+thanh\s+toán|điều\s+khoản\s+thanh\s+toán)\s*[:\-–]?\s*(.+)"]
#: Field, (lines after the hit, least length less one, words in order).
CLAUSES = {
    "force_majeure": (1, 10, [r"bất\s+khả\s+kháng", r"force\s*majeure", r"sự\s+kiện\s+bất\s+khả\s+kháng"]),
    "termination": (1, 15, [r"tạm\s+hoãn.*chấm\s+dứt", r"chấm\s+dứt\s+hợp\s+đồng\s+lao\s+động", r"đơn\s+phương\s+chấm\s+dứt"]),
    "penalty_clause": (1, 10, [r"phạt\s+vi\s+phạm", r"mức\s+phạt", r"tiền\s+phạt"]),
    "indemnity": (1, 10, [r"bồi\s+thường", r"bồi\s+hoàn"]),
    "dispute_resolution": (1, 15, [r"(?:trọng\s+tài|tòa\s+án)\s+có\s+thẩm\s+quyền", r"giải\s+quyết\s+tranh\s+chấp"]),
    "governing_law": (0, 10, [r"pháp\s+luật\s+lao\s+động", r"luật\s+áp\s+dụng", r"pháp\s+luật\s+(?:áp\s+dụng|điều\s+chỉnh|hiện\s+hành)"]),
    "confidentiality": (0, 5, [r"bảo\s+mật", r"bí\s+mật", r"confidential"]),
    "severability": (0, 10, [r"độc\s+lập\s+của\s+điều\s+khoản", r"vô\s+hiệu\s+(?:từng|một)\s+phần", r"severab"]),
    "amendments": (1, 15, [r"sửa\s+đổi(?:\s+bổ\s+sung)?", r"phụ\s+lục\s+(?:sửa|hợp\s+đồng)"]),
}
KINDS = ["HỢP ĐỒNG LAO ĐỘNG", "HỢP ĐỒNG THƯƠNG MẠI", "HỢP ĐỒNG MUA BÁN", "HỢP ĐỒNG DỊCH VỤ", "HỢP ĐỒNG THUÊ", "HỢP ĐỒNG HỢP TÁC"]
NO_INFO = "Không có thông tin hợp đồng."


def first_match(text: Column, patterns: list[str], flags: str = "(?is)") -> Column:
    """Group 1 of the first pattern that gives more than one character; null if none does."""
    found = [strip(F.regexp_extract(text, flags + UNI + p, 1)) for p in patterns]
    return F.coalesce(*[once(x, lambda v: F.when(F.length(v) > 1, v)) for x in found])


def line_around(text: Column, word: str, after: int = 2, lines: Column | None = None, low: Column | None = None) -> Column:
    """The first line with the pattern and ``after`` more, without a clause head as last line, white space collapsed; null if there is none.

    lines, low: the text's lines and the text folded, where a row has them already; with ``low`` the lines are only read where the pattern may fit.
    """
    lines = F.split(text, "\n") if lines is None else lines

    def from_line(at: Column) -> Column:
        near = F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), after + 1), "\n")
        headed = lambda x: F.contains(x, F.lit("\nĐiều")) | F.contains(x, F.lit("\nĐIỀU"))
        bare = once(near, lambda x: F.when(headed(x), F.regexp_replace(x, rf"{UNI}\n(?:Điều|ĐIỀU)\s+\d+.*$", "")).otherwise(x))
        return F.when(at > 0, strip(F.regexp_replace(bare, rf"{UNI}\s+", " ")))

    found = once(F.array_position(F.transform(lines, lambda x: x.rlike(f"(?i){UNI}{word}")), True).cast("int"), from_line)
    return found if low is None else F.when(may_fit(low, word), found)


def _dates(text: Column) -> list[Column]:
    start = F.coalesce(first_match(text, STARTS), first_match(text, [rf"Từ\s+ngày\s*.*?({LONG_DATE})"], "(?i)"))
    end = F.coalesce(first_match(text, ENDS), first_match(text, [rf"Đến\s+ngày\s*.*?({LONG_DATE})"], "(?i)"))
    dated = text.rlike(f"(?i){UNI}{ANY_DATE}")  # a text without a day isn't searched for what leads to one
    return [F.when(dated, c).alias(name) for c, name in ((first_match(text, SIGNED), "execution_date"), (start, "start_date"), (end, "end_date"))]


def _money(text: Column) -> list[Column]:
    named = first_match(text, METHODS)
    method = F.when(named.isNotNull(), named).when(~text.rlike(f"(?i){UNI}{BARE_METHOD}"), line_around(text, r"trả\s+lương\s+vào\s+ngày", 0))
    terms = F.coalesce(first_match(text, TERMS), line_around(text, r"thanh\s+toán\s+đầy\s+đủ", 0))
    return [first_match(text, VALUES).alias("contract_value"), method.alias("payment_method"), terms.alias("payment_terms")]


def contract_dates(contracts: DataFrame) -> DataFrame:
    """contract_id, execution_date, start_date, end_date as written."""
    return composed(contracts).select("contract_id", *_dates(F.col("text")))


def finance(contracts: DataFrame) -> DataFrame:
    """contract_id, contract_value, payment_method (null where only a sentence names it), payment_terms."""
    return composed(contracts).select("contract_id", *_money(F.col("text")))


def _cut(contracts: DataFrame) -> DataFrame:
    """contract_id, text with its letters composed, its ``_lines``, and ``_low``: the text folded."""
    return computed(composed(contracts), _lines=F.split("text", "\n"), _low=folded(F.col("text")))


def _with_clauses(cut: DataFrame) -> DataFrame:
    """cut (see _cut) with a column for each kind of clause; what isn't asked for isn't looked for. The penalty comes first, since the indemnity is held against it."""

    def pick(name, ok=lambda x: F.lit(True)):
        after, least, words = CLAUSES[name]
        found = [line_around(F.col("text"), w, after, F.col("_lines"), F.col("_low")) for w in words]
        return F.coalesce(*[once(x, lambda v: F.when((F.length(v) > least) & ok(v), v)) for x in found])

    special = {"termination": lambda x: ~F.contains(F.lower(x), F.lit("bồi thường")), "indemnity": lambda x: ~x.eqNullSafe(F.col("penalty_clause"))}
    first = cut.withColumn("penalty_clause", pick("penalty_clause"))
    return first.withColumns({name: pick(name, *[special[name]] if name in special else []) for name in CLAUSES if name != "penalty_clause"})


def clause_fields(contracts: DataFrame) -> DataFrame:
    """contract_id and one column for each kind of clause in CLAUSES: its lines, if long enough.

    A termination that speaks of compensation, and an indemnity equal to the penalty, don't count.
    """
    return _with_clauses(_cut(contracts)).select("contract_id", *CLAUSES)


def contract_type(text: Column) -> Column:
    """What follows 'Hợp đồng' on its line (4 to 119 characters), else the first of KINDS. The text's letters are composed (see functions.text.nfc)."""
    named = strip(F.regexp_extract(text, rf"(?i){UNI}HỢP\s+ĐỒNG\s+(.+?)(?:\n|\(|$)", 1))
    known = [F.when(F.contains(F.upper(text), F.lit(k)), F.initcap(F.lit(k))) for k in KINDS]
    return F.coalesce(F.when(F.length(named).between(4, 119), F.concat(F.lit("Hợp đồng "), named)), *known)


def parse_contracts(contracts: DataFrame) -> DataFrame:
    """One row a contract: kind, parties, dates, money, kinds of clause, and the arrays of parties and clauses."""
    text = F.col("text")
    kind = contract_type(text).alias("contract_type")
    with_clauses = _cut(contracts).select("contract_id", "text", "_lines", "_low", clause_array(text).alias("clauses"), party_array(text).alias("parties"), kind, *_dates(text), *_money(text))
    own = [c for c in with_clauses.columns if c not in ("text", "_lines", "_low")]
    return _with_clauses(with_clauses).select(*own, F.lit(None).cast("string").alias("duration"), *CLAUSES)


def contract_summary(analysis: DataFrame) -> DataFrame:
    """contract_id, info: lines of kind, parties, start, end and value; a fixed sentence if there are none."""
    line = lambda label, c: F.concat(F.lit(label), F.col(c))
    parties = F.when(F.size("parties") > 0, F.concat(F.lit("Các bên:\n"), F.array_join(F.transform("parties", lambda p: F.concat(F.lit("  - "), p["role"], F.lit(": "), p["name"])), "\n")))
    info = F.concat_ws("\n", line("Loại: ", "contract_type"), parties, line("Ngày bắt đầu: ", "start_date"), line("Ngày kết thúc: ", "end_date"), line("Giá trị: ", "contract_value"))
    return analysis.select("contract_id", F.coalesce(blank_to_null(info), F.lit(NO_INFO)).alias("info"))

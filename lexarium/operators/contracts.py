"""Contract, knowledge-base, risk and chat operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cleaning import UNI, blank_to_null, composed, computed, strip
from ..functions.text import once

#: Heads of clauses and of the parties, and how a party's fields are written; those of the parties in either case.
CLAUSE_HEAD = r"(?:^|\n)\s*(?:Điều|ĐIỀU)\s+(\d+)\s*[.:)\-–]\s*"
PARTY_A = r"(?i)BÊN\s+A\s*:?\s*\(?\s*([^)\n]*?)\s*\)?\s*\n"
PARTY_B = r"(?i)BÊN\s+B\s*:?\s*\(?\s*([^)\n]*?)\s*\)?\s*\n"
COMPANY = r"(?i)(?:Công\s+ty|Doanh\s+nghiệp)\s*[:\t]+\s*(.+)"
TAX_ID = r"(?i)Mã\s+số\s+thuế\s*[:\t]+\s*(\d+)"
REPRESENTATIVE = r"(?i)Đại\s+diện\s*[:\t]+\s*(.+)"
ADDRESS = r"(?i)Đ[ịi]a\s+chỉ\s*[:|\t]+\s*(.+?)(?:\t|\||\n|Điện\s+thoại|$)"
WORKER = r"(?i)Họ\s+(?:và\s+)?tên\s*\|?\s*[:\t]+\s*(.+?)(?:\t|\||\n|Giới\s+tính|Sinh\s+ngày)"
ID_NUMBER = r"(?i)C(?:MN|CC)D\s*(?:số\s*)?\s*[:|\t\-\s]+\s*(\d{9,12})"
ROLES = ("Người sử dụng lao động", "Người lao động")
#: Characters after the first party's heading in which its fields are, and of a representative.
PARTY_BLOCK, REPRESENTATIVE_CHARS = 2000, 120


def clause_array(text: Column) -> Column:
    """Array of (clause_number, title, summary) of the pieces from line-start 'Điều n' on.

    title: the first line that isn't blank, 150 characters at most; null if there is none. summary: the lines, white space collapsed, without '- ' before.
    """
    head = f"(?m){UNI}{CLAUSE_HEAD}"

    def clause(n: Column, body: Column) -> Column:
        lines = F.filter(F.transform(F.split(strip(body), "\n"), strip), lambda x: x != "")
        flat = lambda ls: F.regexp_replace(F.trim(F.regexp_replace(F.array_join(ls, " "), rf"{UNI}\s+", " ")), "^- ", "")
        return once(lines, lambda ls: F.struct(n.alias("clause_number"), F.substring(F.get(ls, F.lit(0)), 1, 150).alias("title"), flat(ls).alias("summary")))

    return F.zip_with(F.regexp_extract_all(text, F.lit(head), F.lit(1)), F.slice(F.split(text, head, -1), 2, 1 << 30), clause)


def extract_clauses(contracts: DataFrame) -> DataFrame:
    """contract_id, pos, clause_number, title, summary; see clause_array."""
    return composed(contracts).select("contract_id", F.posexplode(clause_array(F.col("text"))).alias("pos", "c")).select("contract_id", "pos", "c.*")


def party_array(text: Column) -> Column:
    """Array of (name, role, address, tax_id, representative) of the parties that are named.

    The first: company, tax id, address and representative in the block after its heading; none without heading and company. The second: the worker's name and id
    number of the whole text, the address of its last quarter, else of all; its heading may be missing.
    """
    # each pattern is looked for once a row: what blank_to_null is given would be made twice
    blank = lambda x: once(x, blank_to_null)
    pick = lambda t, p: blank(strip(F.regexp_extract(t, UNI + p, 1)))
    role = lambda t, p, default: F.coalesce(pick(t, p), F.lit(default))

    def party(name, role, address, tax_id, representative):
        return F.struct(name.alias("name"), role.alias("role"), address.alias("address"), tax_id.alias("tax_id"), representative.alias("representative"))

    def first(head: Column) -> Column:
        """What is written like the heading fits its pattern, so the heading is the first of these."""
        block = F.when(head != "", F.substring(text, F.instr(text, head) + F.length(head), F.lit(PARTY_BLOCK)))
        return once(block, lambda b: party(pick(b, COMPANY), role(head, PARTY_A, ROLES[0]), pick(b, ADDRESS), pick(b, TAX_ID), F.substring(pick(b, REPRESENTATIVE), 1, REPRESENTATIVE_CHARS)))

    a = once(F.regexp_extract(text, UNI + PARTY_A, 0), first)
    n = F.length(text)
    tail = F.substring(text, F.floor(n * 3 / 4).cast("int") + 1, n)
    cell = lambda x: strip(F.regexp_replace(x, rf"{UNI}\s*\|.*$", ""))
    address = F.regexp_replace(cell(F.coalesce(pick(tail, ADDRESS), pick(text, ADDRESS))), rf"{UNI}^[:|\s]+", "")
    b = party(blank(cell(pick(text, WORKER))), role(text, PARTY_B, ROLES[1]), address, pick(text, ID_NUMBER), F.lit(None).cast("string"))
    return F.filter(F.array(a, b), lambda x: x["name"].isNotNull())


def contract_parties(contracts: DataFrame) -> DataFrame:
    """contract_id, name, role, address, tax_id, representative: a row for each party; see party_array."""
    return composed(contracts).select("contract_id", F.explode(party_array(F.col("text"))).alias("p")).select("contract_id", "p.*")


def build_kb(chunks: DataFrame, docs: DataFrame, limit: int = 1000, in_force: bool = False) -> DataFrame:
    """Chunks with their document's number and date; blank chunks go, text is cut to ``limit`` characters. Only slim columns of ``docs`` are joined.

    in_force: only of documents whose status_flag is 1.
    """
    kept = docs.where("status_flag = 1") if in_force else docs
    slim = kept.select("doc_id", "doc_number", F.coalesce("issued_date", F.lit("")).alias("issued_date"))
    own = chunks.where(F.trim("chunk_text") != "").select("doc_id", "chunk_ref", "chunk_index", F.substring("chunk_text", 1, limit).alias("chunk_text"))
    return own.join(slim, "doc_id")


#: Fields of a clause's evaluation.
EVALUATION = "clause_ref string, severity string, issue string, legal_basis string, recommendation string"


def one_json(text: Column, schema: str) -> Column:
    """The object that a text is as a whole, null if it isn't one: what follows an object isn't passed over, as ``from_json`` does."""
    inside = lambda t, before, after, kind: F.from_json(F.concat(F.lit(before), t, F.lit(after)), kind)
    listed = lambda t: inside(t, "[", "]", f"array<struct<{schema}>>")
    whole = lambda t: inside(t, '{"x":', "}", f"x struct<{schema}>")["x"].isNotNull()
    return once(text, lambda t: once(listed(t), lambda found: F.when((F.size(found) == 1) & whole(t), found[0])))


def parse_responses(responses: DataFrame) -> DataFrame:
    """contract_id, pos and the fields of the outermost braces of a model's text; rows whose braces don't hold one JSON object go."""
    j = one_json(F.nullif(F.regexp_extract("response", r"(?s)\{.*\}", 0), F.lit("")), EVALUATION)
    parsed = computed(responses.select("contract_id", "pos", "response"), j=j).where("j.severity is not null or j.issue is not null")
    return parsed.select("contract_id", "pos", "j.*")


def collect_risks(evals: DataFrame) -> DataFrame:
    """contract_id, clause_ref, issue, severity, legal_basis, recommendation of the critical and warning evaluations."""
    sev = F.coalesce("severity", F.lit("ok"))
    ref = F.coalesce(F.col("clause_ref"), F.concat(F.lit("Điều "), F.col("pos")))
    more = [F.col(c) if c in evals.columns else F.lit(None).cast("string").alias(c) for c in ("legal_basis", "recommendation")]
    return evals.where(sev.isin("critical", "warning")).select("contract_id", ref.alias("clause_ref"), "issue", sev.alias("severity"), *more)


def risk_counts(risks: DataFrame, clauses: DataFrame) -> DataFrame:
    """contract_id, critical, warning, clauses: of each contract with clauses or risks."""
    n = risks.groupBy("contract_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))
    of = clauses.groupBy("contract_id").agg(F.count(F.lit(1)).alias("clauses"))
    return of.join(n, "contract_id", "full_outer").select("contract_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "warning", "clauses")])


def overall_risk(risks: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """contract_id, critical, warning, overall_risk; with ``clauses`` their number too, and contracts without a risk."""
    n = risk_counts(risks, risks.select("contract_id") if clauses is None else clauses)
    grade = F.when(F.col("critical") >= 3, "critical").when(F.col("critical") >= 1, "high").when(F.col("warning") >= 3, "medium").otherwise("low")
    n = n.withColumn("overall_risk", grade)
    return n.drop("clauses") if clauses is None else n


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """conv_id, history: each conversation's last n pairs of question and answer, old to new, as lines 'User: …' and 'Assistant: …'.

    A pair is a user's turn and the first assistant's turn before the next one of the user; without it the answer is empty. The last
    n user turns are found with a limit in each task, and all others that are older go before anything is grouped.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    users = turns.where("role = 'user'").select("conv_id", "turn").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    since = users.groupBy("conv_id").agg(F.collect_list("turn").alias("_users"))
    own = turns.where("role in ('user', 'assistant')").join(since, "conv_id").where(F.col("turn") >= F.array_min("_users"))
    pair = F.size(F.filter("_users", lambda u: u <= F.col("turn"))).alias("pair")
    said = lambda who: F.coalesce(F.min_by(F.when(F.col("role") == who, F.col("text")), F.when(F.col("role") == who, F.col("turn"))), F.lit(""))
    pairs = own.select("conv_id", "turn", "role", "text", pair).groupBy("conv_id", "pair").agg(F.concat(F.lit("User: "), said("user"), F.lit("\nAssistant: "), said("assistant")).alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("pair", "line")))
    return pairs.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def owned(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose (contract_id, user_id) is registered."""
    return requests.join(registry.select("contract_id", "user_id"), ["contract_id", "user_id"], "left_semi")


def reassemble(chunks: DataFrame) -> DataFrame:
    """contract_id, text: a contract's chunks joined with newlines in the order of chunk_index, then text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("contract_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))

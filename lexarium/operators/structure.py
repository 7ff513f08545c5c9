"""Sections of legal texts and chunks of contracts.

Sections need no Python: a line's parent is the nearest earlier section of smaller depth since the last title or appendix, which is
a running window over the document's lines.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import terms as W
from ..functions.cleaning import UNI, blank_to_null, composed, computed, strip
from ..sources.shared import dealt

#: Depth of sections that are neither numbered nor titles; nothing hangs under them.
LEAF = 99
#: Private-use letters that mark where a clause's head and body start.
HEAD, BODY = "\ue000", "\ue001"
DEPTH = {k: d for k, d, _ in W.SECTIONS} | {"title_section": 0}


def _plain(raw: Column) -> Column:
    """A line without markdown marks."""
    return F.translate(F.regexp_replace(F.regexp_replace(raw, r"\*\*", ""), r"\\([.\-+])", "$1"), "|", " ")


def articles(docs: DataFrame) -> DataFrame:
    """doc_id, article: the numbers of the lines that classify_lines calls 'dieu', each a section of section_tree, without the tree."""
    head = next(p for k, _, p in W.SECTIONS if k == "dieu")
    likely = F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x.rlike("^[đĐ*]"))  # its first letter, or a mark
    numbers = F.filter(F.transform(likely, lambda x: F.regexp_extract(_plain(x), UNI + head, 1)), lambda n: n != "")
    return docs.select("doc_id", F.explode(numbers).alias("article"))


def classify_lines(docs: DataFrame, legal_basis: bool = False) -> DataFrame:
    """doc_id, line_no, section_type, number, text: each line that isn't blank, without markdown marks.

    section_type is a section's kind, title_section (only before the first chapter, section or article), signing or body; with legal_basis also
    that, for lines 'Căn cứ …' before the first chapter, section or article.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "raw")).withColumn("raw", strip(F.col("raw"))).where("raw <> ''")
    lines = lines.withColumn("text", _plain(F.col("raw")))
    kind = F.coalesce(*[F.when(F.col("text").rlike(UNI + p), k) for k, _, p in W.SECTIONS])
    number = F.coalesce(*[F.when(F.col("_k") == k, F.regexp_extract("text", UNI + p, 1)) for k, _, p in W.SECTIONS])
    lines = lines.withColumn("_k", kind)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.max(F.col("_k").isin("chuong", "muc", "dieu")).over(before), F.lit(False))
    title = F.length("raw").between(3, 120) & F.upper("raw").rlike(UNI + W.TITLES) & ~F.col("_begun")
    lines = lines.withColumn("_begun", begun)
    signing = F.when(F.col("text").rlike(UNI + W.SIGNING), "signing").otherwise("body")
    basis = F.when(F.lit(legal_basis) & F.col("text").rlike(UNI + W.LEGAL_BASIS) & ~F.col("_begun"), "legal_basis")
    return lines.select("doc_id", "line_no", F.coalesce("_k", F.when(title, "title_section"), basis, signing).alias("section_type"), blank_to_null(number).alias("number"), "text")


def _depth(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DEPTH.items() for x in kv])[kind], F.lit(LEAF))


def section_tree(docs: DataFrame, legal_basis: bool = False, tasks: int | None = None) -> DataFrame:
    """doc_id, node_id, parent_id (null: top), depth, section_type, number, heading, content: own lines of each section.

    Body lines belong to the section before them; those before any section are its header. Whole documents are dealt over ``tasks``, by default
    as many as their rows and characters need, so that what a task sorts doesn't grow with the input.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no")
    lines = classify_lines(dealt(docs.select("doc_id", "content"), "doc_id", "content", tasks), legal_basis).withColumn("_first", F.row_number().over(by_line) == 1)
    lines = lines.withColumn("section_type", F.when(F.col("_first") & (F.col("section_type") == "body"), "header").otherwise(F.col("section_type")))
    starts = (F.col("section_type") != "body").cast("int")
    run = by_line.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("node_id", F.sum(starts).over(run))
    text = lambda a: F.transform(F.array_sort(a), lambda x: x["text"])
    first = lambda c: F.min_by(c, "line_no").alias(c)
    nodes = lines.groupBy("doc_id", "node_id").agg(first("section_type"), first("number"), first("text"), F.collect_list(F.struct("line_no", "text")).alias("_l"))
    nodes = nodes.select("doc_id", "node_id", "section_type", "number", F.when(F.col("section_type") == "header", "").otherwise(F.col("text")).alias("heading"), F.array_join(text(F.col("_l")), "\n").alias("content"))
    nodes = nodes.withColumn("depth", _depth(F.col("section_type")))
    by_node = Window.partitionBy("doc_id").orderBy("node_id")
    reset = F.col("section_type").isin("title_section", "phu_luc", "legal_basis")
    nodes = nodes.withColumn("_epoch", F.sum(reset.cast("int")).over(by_node.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("doc_id", "_epoch").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("depth") == d, F.col("node_id"))).over(earlier) for d in range(5)]
    nodes = nodes.withColumns({f"_d{d}": x for d, x in enumerate(last)})
    under = [F.when(F.col("depth") > d, F.col(f"_d{d}")) for d in range(5)]
    parent = F.when((F.col("depth") < LEAF) & ~reset, F.greatest(*under))
    return nodes.select("doc_id", "node_id", parent.alias("parent_id"), "depth", "section_type", "number", "heading", "content")


def html_sections(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """The section tree of pages (url, content: their blocks as lines, see sources.html.block_text), with url as doc_id; 'Căn cứ …' is legal_basis.

    tasks: see section_tree; where it is given (``tasks_for`` the pages) the blocks aren't read once more to count them.
    """
    return section_tree(blocks.select(F.col("url").alias("doc_id"), "content"), legal_basis=True, tasks=tasks)


def rolled_up(nodes: list[tuple]) -> dict[int, str]:
    """Content of each node (id, parent, content; ids in order of the text) with that of its children, where not already in it, from the bottom up."""
    content = {i: t for i, _, t in nodes}
    kids: dict[int, list[int]] = {}
    for i, parent, _ in nodes:
        if parent is not None:
            kids.setdefault(parent, []).append(i)
    for i in sorted(kids, reverse=True):  # a child's number is above its parent's
        for k in kids[i]:
            if content[k] not in content[i]:
                content[i] += "\n" + content[k]
    return content


def rollup_content(tree: DataFrame) -> DataFrame:
    """The tree with the content of each section's children, where not already in it, added from the bottom up.

    A task's rows come in order of documents and nodes, so one pass over them folds a document when the next begins; only that document is held.
    """
    schema = tree.schema
    names = schema.names

    def run(batches):
        held: list[pa.RecordBatch] = []

        def folded() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            starts, ids, parents, texts = (t[c].to_pylist() for c in ("_n", "node_id", "parent_id", "content"))
            at = [i for i, n in enumerate(starts) if n == 1] + [len(ids)]
            out = []
            for a, b in zip(at, at[1:]):
                whole = rolled_up(list(zip(ids[a:b], parents[a:b], texts[a:b], strict=True)))
                out += [whole[i] for i in ids[a:b]]
            column = t.schema.get_field_index("content")
            return t.set_column(column, "content", pa.array(out, t.schema.field(column).type)).select(names).combine_chunks().to_batches()[0]

        for b in batches:
            begins = [i for i, n in enumerate(b.column("_n").to_pylist()) if n == 1]
            if begins:  # all documents but the last one of the batch are whole
                if begins[-1]:
                    held.append(b.slice(0, begins[-1]))
                if held:
                    yield folded()
                held = [b.slice(begins[-1])]
            elif b.num_rows:
                held.append(b)
        if held:
            yield folded()

    in_order = tree.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")))
    return in_order.mapInArrow(run, schema)


def mark_enforcement(tree: DataFrame) -> DataFrame:
    """Articles of an enforcement chapter, and those with such a heading, become ``enforcement``.

    If no article outside such chapters has the heading, the last one that says 'this act takes effect' does too.
    """
    like = F.col("heading").rlike(UNI + W.ENFORCEMENT)
    reset = F.col("section_type").isin("title_section", "phu_luc", "chuong")
    run = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    article = F.col("section_type") == "dieu"
    inside = F.last(F.when(reset, (F.col("section_type") == "chuong") & like), ignorenulls=True).over(run)
    whole = Window.partitionBy("doc_id")
    marked = tree.withColumn("_in", article & F.coalesce(inside, F.lit(False))).withColumn("_own", article & ~F.col("_in") & like)
    says = article & ~F.col("_in") & F.concat_ws(" ", "heading", F.substring("content", 1, 300)).rlike(UNI + W.IN_FORCE)
    marked = marked.withColumn("_any", F.max("_own").over(whole)).withColumn("_last", F.max(F.when(says, F.col("node_id"))).over(whole))
    hit = F.col("_in") | F.col("_own") | (~F.col("_any") & (F.col("node_id") == F.col("_last")))
    return marked.withColumn("section_type", F.when(F.coalesce(hit, F.lit(False)), "enforcement").otherwise(F.col("section_type"))).drop("_in", "_own", "_any", "_last")


def document_chunks(tree: DataFrame) -> DataFrame:
    """doc_id, chunk_ref, chunk_index (from 0), section_type, chunk_text."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")) - 1
    chunks = tree.select("doc_id", i.alias("chunk_index"), "section_type", F.col("content").alias("chunk_text"))
    return chunks.withColumn("chunk_ref", F.concat_ws("-", "doc_id", "chunk_index"))


def split_text(text: str, size: int = 1000, overlap: int = 50, seps: tuple[str, ...] = ("\n\n", "\n", ".", " ", "")) -> list[str]:
    """Pieces filled up to ``size`` at the coarsest separator that serves, each after the first led by the end of the one before."""
    if len(text) <= size:
        return [text] if text else []
    sep, finer = seps[0], seps[1:]
    pieces: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        nonlocal length
        if joined := sep.join(held):
            pieces.append(joined)
        held.clear()
        length = 0

    for part in text.split(sep) if sep else text:
        grown = length + len(sep) + len(part) if length else len(part)
        if grown > size:
            flush()
            if len(part) > size and finer:
                pieces += split_text(part, size, overlap, finer)
                continue
            grown = len(part)
        if not length:
            held.clear()
        held.append(part)
        length = grown
    flush()
    if overlap <= 0:
        return pieces
    return pieces[:1] + [a[-overlap:] + b for a, b in zip(pieces, pieces[1:])]


def _split_rows(df: DataFrame, keep: list[str], size: int, overlap: int) -> DataFrame:
    """Rows with pieces of ``text`` as (sub, text)."""
    fields = StructType([*df.select(*keep).schema, StructField("sub", IntegerType()), StructField("text", StringType())])

    def run(batches):
        for b in batches:
            rows = [(i, s, p) for i, t in enumerate(b.column("text").to_pylist()) for s, p in enumerate(split_text(t, size, overlap))]
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [b.column(c).take(at) for c in keep] + [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "sub", "text"])

    return df.select(*keep, "text").mapInArrow(run, fields)


def chunk_by_clause(contracts: DataFrame, size: int = 1000, overlap: int = 50) -> DataFrame:
    """contract_id, clause_number, chunk_index (from 1), text: pieces from 'Điều/Khoản n' on, long ones split; text before is the Preamble.

    Without such a head the text is split as it is and numbered from 1. Blank texts have no chunk.
    """
    head = r"(?:Điều|ĐIỀU|Khoản|KHOẢN)\s+(\d+)[.:\-)]"
    parts = F.split("text", rf"{UNI}(?={head})")
    each = composed(contracts).select("contract_id", F.posexplode(F.transform(parts, strip)).alias("part", "text")).where("text <> ''")
    number = F.regexp_extract("text", rf"{UNI}^{head}", 1)
    each = each.withColumn("clause_number", F.coalesce(blank_to_null(number), F.lit("Preamble")))
    split = _split_rows(each, ["contract_id", "part", "clause_number"], size, overlap)
    i = F.row_number().over(Window.partitionBy("contract_id").orderBy("part", "sub"))
    none = F.max(F.col("clause_number") != "Preamble").over(Window.partitionBy("contract_id"))
    out = split.withColumn("chunk_index", i).withColumn("_named", none)
    return out.select("contract_id", F.when(F.col("_named"), F.col("clause_number")).otherwise(F.col("chunk_index").cast("string")).alias("clause_number"), "chunk_index", "text")


def clause_dicts(contracts: DataFrame) -> DataFrame:
    """contract_id, pos, clause_number, text: a contract cut at line-start 'Điều n'; what is before, or a text without one, is clause 0.

    The heads keep their white space. The letters U+E000 and U+E001 are dropped from texts.
    """
    held = F.contains("text", F.lit(HEAD)) | F.contains("text", F.lit(BODY))  # looked for first, which takes far less time
    text = F.when(held, F.translate("text", HEAD + BODY, "")).otherwise(F.col("text"))
    marked = F.regexp_replace(text, rf"(?m){UNI}(?:^|\n)\s*(?:Điều|ĐIỀU)\s+\d+\s*[.:)\-]\s*", f"{HEAD}$0{BODY}")
    # each piece is cut once: its head and what follows, or a text without a head
    parts = computed(composed(contracts), _parts=F.transform(F.split(marked, HEAD), lambda p: F.split(p, BODY)))
    each = parts.select("contract_id", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("pos", "cut"))
    first, rest = F.get("cut", F.lit(0)), F.get("cut", F.lit(1))
    body = F.when(F.col("_n") == 1, first).when(F.col("pos") == 0, strip(first)).otherwise(F.concat(first, strip(rest)))
    number = F.when(F.col("pos") == 0, "0").otherwise(F.regexp_extract(first, r"(\d+)", 1))
    return each.select("contract_id", "pos", number.alias("clause_number"), body.alias("text")).where((F.col("pos") > 0) | (F.col("text") != ""))

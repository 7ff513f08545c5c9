"""Changes of acts line by line, and dates of single provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cleaning import UNI, blank_to_null, computed, strip
from ..functions.text import normalize_doc_number, once
from .dates import LONG, _date

#: Changes of a line, in order: action, what is named (of article, clause, point, special, old, new), pattern.
_FIX = r"Sửa\s*đổi,\s*bổ\s*sung"
_ART = r"(?:của\s+)?Điều\s+(\d+)"
_CL = r"khoản\s+(\d+[a-zđ]*)"
_PT = r"điểm\s+([a-zđ])"
_APP = r"Phụ\s+lục\s+([IVXL\d]+|[A-Z]+)"
_SWAP = r'Thay\s+thế\s+cụm\s+từ\s*"([^"]+)"\s*bằng\s*(?:cụm\s+từ\s*)?"([^"]+)"\s+tại'
CHANGES = [
    ("replaced_phrase", "old new point clause article", rf"{_SWAP}\s+{_PT}\s+{_CL}\s+{_ART}"),
    ("replaced_phrase", "old new clause article", rf"{_SWAP}\s+{_CL}\s+{_ART}"),
    ("amended", "point clause article", rf"{_FIX}\s+{_PT}\s+{_CL}\s+{_ART}"),
    ("amended", "special clause article", rf"{_FIX}\s+(đoạn\s+đầu)\s+(?:của\s+)?{_CL}\s+{_ART}"),
    ("amended", "clauses article", rf"{_FIX}\s+((?:khoản\s+\d+[a-zđ]*(?:\s*,\s*|\s+và\s+)?)+)\s+{_ART}"),
    ("amended", "article", rf"{_FIX}\s+Điều\s+(\d+)"),
    ("supplemented", "clause article", rf"Bổ\s*sung\s+{_CL}\s+vào\s+sau\s+khoản\s+\d+[a-zđ]*\s+{_ART}"),
    ("abolished", "clause article", rf"Bãi\s*bỏ\s+{_CL}\s+{_ART}"),
    ("abolished", "article", rf"Bãi\s*bỏ\s+{_ART}"),
    ("amended", "section chapter", rf"{_FIX}\s+tên\s+Mục\s+(\d+)\s+Chương\s+([IVXL\d]+)"),
    ("supplemented", "special", rf"Bổ\s*sung\s+{_APP}\s+vào\s+sau"),
    ("amended", "appendix", rf"(?:{_FIX}|Bổ\s*sung,\s*(?:bãi\s*bỏ|sửa\s*đổi))\s+(?:một\s+số\s+số\s+thứ\s+tự\s+(?:của\s+)?)?{_APP}"),
    ("replaced_phrase", "special", rf"Thay\s+thế\s+{_APP}"),
    ("abolished", "special", rf"Bãi\s*bỏ\s+{_APP}"),
    ("abolished", "row", r"Bãi\s*bỏ\s+(?:ngành,\s*nghề\s+)?[^.]*?số\s+thứ\s+tự\s+(\d+)"),
    ("amended", "row", r"(?:Sửa\s*đổi,\s*bổ\s*sung|Sửa\s*đổi)\s+số\s+thứ\s+tự\s+(\d+)"),
    ("supplemented", "row", r"(?<!đổi, )Bổ\s*sung\s+số\s+thứ\s+tự\s+(\d+)"),
]
#: A list of clauses on the lines after, a line of it, and where it ends; an act that ends but for some articles.
SOME_CLAUSES = rf"{_FIX}\s+một\s+số\s+khoản\s+{_ART}"
SUB_CLAUSE = rf"[a-zđ]\)\s*{_FIX}\s+{_CL}"
NEXT_ITEM = r"^\d+[.)]\s+(?:Sửa|Bãi|Bổ)"
PARTLY = r"(?:Luật|Nghị\s*định)\s+(?:số\s+)?(\d+/\d+/[A-ZĐ]+\d*(?:-[A-ZĐ]+\d*)*)[^;.]*?hết\s+hiệu\s+lực[^;.]*?trừ\s+(.+?)(?:[.;]\s*\z|[.;]\s)"
FIELDS = ("article", "clause", "point", "chapter", "section", "special", "old", "new")
ACT_NUMBER = r"\d+/\d+/[A-ZĐ]+\d*(?:-[A-ZĐ]+\d*)*"
#: Lines and characters of the block after a change.
BLOCK_LINES, BLOCK_CHARS = 60, 2000
#: Lines after a head in which its list is looked for, and lines before a row in which its appendix is.
LIST_LINES, APPENDIX_LINES = 40, 20
NEXT_HEAD = r"^(?:(?:Điều|Chương|Mục|Phần|Phụ lục)\s+[\dIVXLCH]|\d+[a-zđ]*\.\s|[a-zđ]\)\s)"


#: An act named with its number; and what is in each of these: the last letter of its kind or of 'số', and the number's beginning.
ANY_ACT = rf"(?:Luật|Nghị\s*định|Thông\s*tư|Pháp\s*lệnh)\s+(?:số\s+)?({ACT_NUMBER})"
NUMBER_AFTER = r"[tThHưƯốỐ]\s+\d+/\d+/"


def names_act(text: Column) -> Column:
    """Whether a text names an act with its number, so that its amendments have a target."""
    return text.rlike(UNI + NUMBER_AFTER) & text.rlike(f"(?i){UNI}{ANY_ACT}")


def _target(text: Column) -> Column:
    of = rf"(?i){UNI}{_FIX}\s+(?:một\s+số\s+điều|các\s+điều)\s+(?:của\s+)?(?:Luật|Nghị\s*định|Thông\s*tư)\s+(?:số\s+)?({ACT_NUMBER})"
    named = F.coalesce(*[blank_to_null(F.regexp_extract(text, p, 1)) for p in (of, f"(?i){UNI}{ANY_ACT}")])
    return F.when(text.rlike(UNI + NUMBER_AFTER), named)


def amendment_target(docs: DataFrame) -> DataFrame:
    """doc_id, target_doc_number: of 'amends articles of act X', else the first act named with its number; null if none."""
    return docs.select("doc_id", _target(F.col("content")).alias("target_doc_number"))


_CHANGE = "array<struct<action:string,article:string,clause:string,point:string,chapter:string,section:string,special:string,old:string,new:string,_at:int,_block:string>>"


def _change(action: Column | str, at: Column, block: Column | None = None, **fields: Column) -> Column:
    """One change; ``at`` is the line whose block it takes unless the block is given."""
    null = F.lit(None).cast("string")
    return F.struct(
        (F.lit(action) if isinstance(action, str) else action).alias("action"), *[fields.get(f, null).alias(f) for f in FIELDS], at.cast("int").alias("_at"), (null if block is None else block).alias("_block")
    )


def _changes_of(line: Column, at: Column, lines: Column) -> Column:
    """All changes that a line names, of every wording every hit; ``at``: its place among ``lines``."""
    after = F.slice(lines, at + 2, LIST_LINES - 1)
    index = lambda a, p: F.array_position(F.transform(a, lambda x: x.rlike(f"(?i){UNI}{p}")), True).cast("int")
    upto = lambda a, end: F.when(end > 0, F.slice(a, 1, end - 1)).otherwise(a)

    def hits(p, use):
        return once(F.regexp_extract_all(line, F.lit(f"(?i){UNI}{p}"), F.lit(0)), lambda h: F.when(F.size(h) > 0, use(h)).otherwise(F.lit([]).cast(_CHANGE)))

    def clause_list(hit, group):
        """The lines 'a) Sửa đổi, bổ sung khoản n' up to the next item, each with the lines between."""
        number = F.regexp_extract(hit, f"(?i){UNI}{SOME_CLAUSES}", group)

        def of(own):
            starts = F.filter(F.transform(own, lambda x, i: F.when(x.rlike(f"(?i){UNI}{SUB_CLAUSE}"), i)), lambda i: i.isNotNull())
            text = lambda s, k: F.array_join(F.slice(own, s[k] + 2, F.greatest(F.coalesce(F.get(s, k + 1), F.size(own)) - s[k] - 1, F.lit(0))), "\n")
            return once(starts, lambda s: F.transform(s, lambda i, k: _change("amended", at, F.substring(strip(text(s, k)), 1, BLOCK_CHARS), article=number, clause=F.regexp_extract(own[i], f"(?i){UNI}{SUB_CLAUSE}", 1))).cast(_CHANGE))

        return once(upto(after, index(after, NEXT_ITEM)), of)

    def rows_of(appendix):
        """Rows 'a) … số thứ tự n' of an appendix up to the next item; without such rows the appendix."""
        row = rf"(?i){UNI}^[a-zđ]\)\s*.*?(Sửa\s*đổi|Bổ\s*sung|Bãi\s*bỏ)[^.]*?số\s+thứ\s+tự\s+(\d+)"

        def of(own):
            named = F.filter(F.transform(own, lambda x, i: F.when(x.rlike(row), i)), lambda i: i.isNotNull())

            def one(i):
                word = F.lower(F.regexp_extract(own[i], row, 1))
                action = F.when(word.startswith("bãi"), "abolished").when(word.startswith("bổ"), "supplemented").otherwise("amended")
                return _change(action, at + 1 + i, special=F.concat(F.lit("PL"), appendix, F.lit("."), F.regexp_extract(own[i], row, 2)))

            return once(named, lambda n: F.when(F.size(n) > 0, F.transform(n, one).cast(_CHANGE)).otherwise(F.array(_change("amended", at, special=F.concat(F.lit("PL"), appendix))).cast(_CHANGE)))

        return once(upto(after, index(after, NEXT_ITEM)), of)

    def appendix_before():
        """The nearest appendix that a line of the APPENDIX_LINES before amends."""
        p = next(p for _, named, p in CHANGES if named == "appendix")
        before = F.reverse(F.slice(lines, F.greatest(at - APPENDIX_LINES + 1, F.lit(1)), F.least(at, F.lit(APPENDIX_LINES))))
        return F.get(F.filter(F.transform(before, lambda x: F.regexp_extract(x, f"(?i){UNI}{p}", 1)), lambda x: x != ""), F.lit(0))

    def of(action, named, p):
        names = named.split()
        get = lambda h, f: F.regexp_extract(h, f"(?i){UNI}{p}", names.index(f) + 1)
        if named == "clauses article":
            many = lambda h: F.transform(F.regexp_extract_all(get(h, "clauses"), F.lit(r"(?i)(?:\s|^)(\d+[a-zđ]*)"), F.lit(1)), lambda c: _change(action, at, article=get(h, "article"), clause=c))
            return hits(p, lambda hs: F.flatten(F.transform(hs, many)).cast(_CHANGE))
        if named == "appendix":
            return hits(p, lambda hs: F.flatten(F.transform(hs, lambda h: rows_of(get(h, "appendix")))))
        if named == "row":
            each = lambda hs: once(appendix_before(), lambda a: F.when(a.isNotNull(), F.transform(hs, lambda h: _change(action, at, special=F.concat(F.lit("PL"), a, F.lit("."), get(h, "row")))).cast(_CHANGE)).otherwise(F.lit([]).cast(_CHANGE)))
            # rows 'a) …' under their appendix are counted there
            return F.when(line.rlike(r"(?i)^[a-zđ]\)"), F.lit([]).cast(_CHANGE)).otherwise(hits(p, each))
        special = lambda h: F.concat(F.lit("PL"), get(h, "special")) if "Phụ" in p else get(h, "special")
        return hits(p, lambda hs: F.transform(hs, lambda h: _change(action, at, **{f: special(h) if f == "special" else get(h, f) for f in names})).cast(_CHANGE))

    lists = hits(SOME_CLAUSES, lambda hs: F.flatten(F.transform(hs, lambda h: clause_list(h, 1))))
    return F.concat(*[of(*c) for c in CHANGES], lists)


def _partly_abolished(docs: DataFrame) -> DataFrame:
    """Articles that are excepted where an act of another number ends: action abolished_partial, with that act as target."""
    hit = F.explode(F.regexp_extract_all("content", F.lit(f"(?is){UNI}{PARTLY}"), F.lit(0)))
    likely = F.contains("content", F.lit("trừ")) | F.contains("content", F.lit("Trừ"))
    each = docs.where(likely).select("doc_id", F.split("content", "\n").alias("_all"), hit.alias("hit"))
    each = each.select("*", F.regexp_extract("hit", f"(?is){UNI}{PARTLY}", 1).alias("target_doc_number"), F.regexp_extract("hit", f"(?is){UNI}{PARTLY}", 2).alias("_but"))
    first = F.array_position(F.transform("_all", lambda x: F.contains(x, F.split(F.col("hit"), "\n")[0])), True).cast("int") - 1
    named = each.select("*", first.alias("line_start"), F.explode(F.regexp_extract_all("_but", F.lit(f"(?i){UNI}Điều\\s+(\\d+)"), F.lit(1))).alias("article"))
    null = F.lit(None).cast("string")
    return named.select("doc_id", "line_start", F.col("line_start").alias("line_end"), F.lit("abolished_partial").alias("action"), "article", *[null.alias(f) for f in FIELDS[1:]], F.substring("hit", 1, 200).alias("description"), F.substring("hit", 1, BLOCK_CHARS).alias("content"), "target_doc_number")


def extract_amendments(docs: DataFrame, targeted: bool = False) -> DataFrame:
    """One row for each change of an act that a line names: doc_id, line_start, line_end, action, target_doc_number, FIELDS, description, content.

    Every hit of every wording of CHANGES counts, each clause of a list by itself; 'some clauses of an article' and rows of an appendix are read from the
    lines after. content is the block up to the next head or item. Repeated changes of whole articles count once a document. Articles
    excepted where another act ends have the action abolished_partial and that act as target. special of an appendix: PL<n>, of its row PL<n>.<row>.
    targeted: only rows with a target; texts that name no act aren't read for changes.
    """
    plain = F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(strip(x), r"\\([.\-*_])", "$1"))
    target = computed(docs.select("doc_id", "content"), target_doc_number=_target(F.col("content")))
    target = computed(target.where("target_doc_number is not null") if targeted else target, _all=plain)
    each = target.select("doc_id", "_all", "target_doc_number", F.posexplode("_all").alias("line_start", "line")).where(F.col("line").rlike(rf"(?i){UNI}sửa\s*đổi|bổ\s*sung|thay\s+thế|bãi\s*bỏ"))
    each = each.select("*", F.explode(_changes_of(F.col("line"), F.col("line_start"), F.col("_all"))).alias("c")).select("*", "c.*")
    after = F.slice(F.col("_all"), F.col("_at") + 2, BLOCK_LINES)
    stop = lambda a: F.array_position(F.transform(a, lambda x: x.rlike(f"(?i){UNI}{NEXT_HEAD}")), True).cast("int")
    block = once(after, lambda a: once(stop(a), lambda n: F.when(n > 0, F.slice(a, 1, n - 1)).otherwise(a)))
    each = computed(each, _lines=block)
    own = F.coalesce("_block", F.substring(strip(F.array_join("_lines", "\n")), 1, BLOCK_CHARS))
    out = each.select("doc_id", "line_start", (F.col("line_start") + F.size("_lines")).alias("line_end"), "action", *FIELDS, F.col("line").alias("description"), own.alias("content"), "target_doc_number")
    whole = (F.col("action") == "amended") & F.col("article").isNotNull() & F.col("clause").isNull()
    # in one reading of the texts: the others are numbered too, and all stay
    same = Window.partitionBy("doc_id", "_whole", "article").orderBy("line_start")
    own = out.withColumn("_whole", whole).withColumn("_n", F.row_number().over(same)).where(~F.col("_whole") | (F.col("_n") == 1)).drop("_whole", "_n")
    return own.unionByName(_partly_abolished(docs))


def roman(s: Column) -> Column:
    """Roman numbers to 39 as digits; anything else unchanged."""
    tens, ones = ["", "x", "xx", "xxx"], ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"]
    table = [(t + o, str(10 * a + b)) for a, t in enumerate(tens) for b, o in enumerate(ones) if t + o]
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table for x in kv])[F.lower(s)], s)


def _provisions(text: Column) -> Column:
    """Array of (article, clause, appendix) named in a text: clauses of an article, else whole articles; and appendices."""
    some = lambda p, i: F.regexp_extract_all(text, F.lit(f"(?i){UNI}{p}"), F.lit(i))
    numbers = lambda s: F.regexp_extract_all(s, F.lit(r"(\d+)"), F.lit(1))
    none = F.lit(None).cast("string")
    row = lambda a, c, p: F.struct(a.alias("article"), c.alias("clause"), p.alias("appendix"))
    of = r"khoản\s+(\d+(?:\s*(?:,|và)\s*\d+)*)\s+(?:của\s+)?Điều\s+(\d+)"
    clauses = F.flatten(F.transform(F.arrays_zip(some(of, 1).alias("c"), some(of, 2).alias("a")), lambda z: F.transform(numbers(z["c"]), lambda c: row(z["a"], c, none))))
    rest = F.regexp_replace(text, f"(?i){UNI}{of}", "")
    listed = F.regexp_extract_all(rest, F.lit(rf"(?i){UNI}Điều\s+(\d+(?:\s*(?:[,;]|và)\s*\d+)*)"), F.lit(1))
    articles = F.flatten(F.transform(listed, lambda s: F.transform(numbers(s), lambda a: row(a, none, none))))
    appendices = F.transform(some(r"Phụ\s+lục\s+([IVXLCDM]+|\d+)", 1), lambda p: row(none, none, roman(p)))
    return F.concat(clauses, articles, appendices)


_ACT = r"(?:Luật|Nghị\s+định|Thông\s+tư|Quyết\s+định)"
_DAY = rf"({LONG}|\d{{2}}/\d{{2}}/\d{{4}})"


def provision_dates(chunks: DataFrame) -> DataFrame:
    """doc_id, article, clause, appendix, effective_date: provisions with a date of force of their own in enforcement text, distinct.

    Numbered lines are read one by one; those on 'this act' as a whole, and provisions only pointed at after the date, don't count.
    """
    segments = F.split("content", rf"{UNI}\n(?=\d+\s*\.\s)")
    each = chunks.select("doc_id", F.explode(segments).alias("s"))
    p = rf"(?is){UNI}^(.*?)(?<!hết\s)có\s+hiệu\s+lực\s+(?:thi\s+hành\s+)?(?:kể\s+)?từ\s+ngày\s+{_DAY}"
    named = each.select("doc_id", F.regexp_replace(F.regexp_extract("s", p, 1), rf"(?is){UNI}^.*?thi\s+hành\s*\n", "").alias("head"), _date(F.regexp_extract("s", p, 2)).alias("effective_date"))
    named = named.where(F.col("effective_date").isNotNull() & ~F.col("head").rlike(rf"(?i){UNI}{_ACT}\s+này\s*$"))
    return named.select("doc_id", F.explode(_provisions(F.col("head"))).alias("p"), "effective_date").select("doc_id", "p.*", "effective_date").distinct()


def amendment_dates(chunks: DataFrame) -> DataFrame:
    """doc_id, key, date: provisions that are excepted ('trừ …') and end on a day of their own; of one key the first counts.

    Keys: D<article>, D<article>.K<clause>, PL<appendix>.
    """
    p = rf"(?i){UNI}trừ\s+([^\n]+?)\s+hết\s+hiệu\s+lực\s+kể\s+từ\s+ngày\s+{_DAY}"
    hits = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("d"))
    each = chunks.select("doc_id", F.posexplode(hits).alias("_o", "z")).select("doc_id", "_o", F.explode(_provisions(F.col("z.t"))).alias("p"), _date(F.col("z.d")).alias("date"))
    article, clause = F.concat(F.lit("D"), "p.article"), F.concat(F.lit(".K"), "p.clause")
    single = F.coalesce(F.concat(F.lit("PL"), "p.appendix"), F.concat(article, F.coalesce(clause, F.lit(""))))
    keys = F.when(F.col("p.clause").isNotNull(), F.array(article, single)).otherwise(F.array(single))
    rows = each.where("date is not null").select("doc_id", F.explode(keys).alias("key"), "_o", "date")
    return rows.groupBy("doc_id", "key").agg(F.min_by("date", F.struct("_o", "date")).alias("date"))


def amended_by(chunks: DataFrame, amendments: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks (doc_id, article, clause if it has one) that an amendment names, and by: the amending documents with their dates, joined with '; '.

    An amendment of a whole article names all its clauses, one of a clause names it and its article. amendments: doc_id (the amending one),
    target_doc_number, article, clause. docs: doc_id, doc_number, effective_date. Numbers meet normalised.
    """
    number = lambda c: normalize_doc_number(F.col(c))
    known = docs.where("doc_number is not null").select("doc_id", number("doc_number").alias("_k"), "doc_number", "effective_date")
    act = amendments.where("article is not null and target_doc_number is not null").select("doc_id", number("target_doc_number").alias("_k"), "article", "clause").distinct()
    # acts meet the target's number, never each document of it: what names one provision of a number is one list, which its documents share
    by = act.join(known.drop("_k"), "doc_id").select("_k", "article", "clause", F.concat_ws(" ", "doc_number", "effective_date").alias("_by")).distinct()
    key = ["doc_id", "article", "clause"] if "clause" in chunks.columns else ["doc_id", "article"]
    wanted = chunks.select(*key).distinct().join(known.select("doc_id", "_k").distinct(), "doc_id")
    listed = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_all")))), "; ").alias("by")
    all_of = lambda rows, *on: rows.groupBy(*on).agg(F.collect_set("_by").alias("_all"))
    if "clause" not in key:
        return wanted.join(all_of(by, "_k", "article"), ["_k", "article"]).groupBy(*key).agg(listed)
    whole, single = by.where("clause is null"), by.where("clause is not null")
    found = wanted.join(all_of(whole, "_k", "article"), ["_k", "article"]).select(*key, "_all")
    found = found.unionByName(wanted.join(all_of(single, "_k", "article", "clause"), ["_k", "article", "clause"]).select(*key, "_all"))
    found = found.unionByName(wanted.where("clause is null").join(all_of(single, "_k", "article"), ["_k", "article"]).select(*key, "_all"))
    return found.groupBy(*key).agg(listed)

"""Secret scans over a trigram inverted index, with SQL functions only.

From each rule's pattern a Boolean query over trigrams is derived: a conjunction, over the stretches of the pattern that are made of
known letters, of alternatives that are each a conjunction of trigrams. The index has a posting (trigram, doc_id) for each trigram that
some query mentions; postings are intersected by counting, for each document and alternative, the trigrams found. The
documents that satisfy a rule's query are its candidates, over which its pattern is verified; a rule without a mandatory
trigram scans every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import computed
from ._common import helper, id_text, table
from .spans import by_start, count_of, matches, written

#: Strings that a stretch may stand for, at most; beyond, the stretch ends.
_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Of the group, the least length; matches below are dropped.
    group: int = 0
    least: int = 0
    base: bool = False


#: What follows the first line of a private key: all up to its END line; if there is none, key headers and the run of base64 lines, the last of which may be short.
_KEY_BODY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]{1,15}+={0,2}+(?=[ \t\r]*+(?:\n|\\n|$)))?)"
)
#: The kinds in their order, base kinds first.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----" + _KEY_BODY),
    Rule("hosted_git", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Conjunction of disjunctions of conjunctions of lower-case trigrams that every match contains; empty: none is mandatory."""
    query: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        options = {_trigrams(s) for s in strings}
        if frozenset() not in options:
            query.append(sorted((o for o in options if not any(p < o for p in options)), key=sorted))
        return {""}

    def alternatives(node) -> set[str] | None:
        """The strings a node can stand for, if they are few; None if anything may stand there."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(v).lower() for _, v in arg}
        if op is sre.BRANCH:
            found = [strings(list(x)) for x in arg[1]]
            return None if any(x is None for x in found) else set().union(*found)
        if op is sre.SUBPATTERN:
            return strings(list(arg[3]))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
            inner = strings(list(arg[2]))
            return None if inner is None else {""} | inner
        return None

    def strings(nodes) -> set[str] | None:
        out = {""}
        for n in nodes:
            a = alternatives(n)
            if a is None or len(a) * len(out) > _STRINGS:
                return None
            out = {x + y for x in out for y in a}
        return out

    run = {""}
    for node in sre_parser.parse(pattern):
        a = alternatives(node)
        if a is not None and len(a) * len(run) <= _STRINGS:
            run = {x + y for x in run for y in a}
            continue
        run = close(run)
        if a is not None:
            run = a
        elif node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
            inner = strings(list(node[1][2]))
            if inner is not None:
                run = close(inner)
    close(run)
    return query


def plan(rules=RULES) -> list[tuple[str, int, int, str, int, int]]:
    """Rows (kind, stretch, alternative, trigram, trigrams of the alternative, stretches of the rule)."""
    rows = []
    for r in rules:
        q = trigram_query(r.pattern)
        for i, options in enumerate(q):
            for j, grams in enumerate(options):
                rows += [(r.kind, i, j, g, len(grams), len(q)) for g in sorted(grams)]
    return rows


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) of those trigrams that are in a text, without regard to the case of A-Z."""
    # each computed once a row: a filter on ``has`` or an explode of it would else be moved below and compute it again
    low = computed(docs.select("doc_id", "text"), low=F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).select("doc_id", "low")
    found = computed(low, has=F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), t) for t in trigrams])))
    return found.select(F.explode("has").alias("trigram"), "doc_id")


def candidates(spark: SparkSession, docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query a document satisfies. Rules without a query aren't in it."""
    rows = plan(rules)
    # as large as the rules are, whatever the documents
    query = spark.createDataFrame(rows, "kind string, stretch int, option int, trigram string, grams long, stretches long")
    index = postings(docs, sorted({r[3] for r in rows})).repartition("doc_id").distinct()
    met = index.join(F.broadcast(query), "trigram").groupBy("doc_id", "kind", "stretch", "option", "grams", "stretches").agg(F.count(F.lit(1)).alias("n")).where("n = grams")
    ways = met.select("doc_id", "kind", "stretch", "stretches").distinct()
    full = ways.groupBy("doc_id", "kind", "stretches").agg(F.count(F.lit(1)).alias("n")).where("n = stretches")
    return full.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text (null: empty) and spans (start, order, stop, kind, value; by start, then kind) of each row.

    Rows that share an id are each scanned by the rules that any of them may match. A null id is an id like others.
    """
    docs = id_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    known = candidates(docs.sparkSession, docs, rules).withColumnRenamed("doc_id", "of")
    scanned = {r[0] for r in plan(rules)}
    both = docs.join(known.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    all_spans = []
    for order, r in enumerate(rules):
        test = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if r.kind in scanned else None
        keep = (lambda v, r=r: F.length(F.regexp_extract(v, r.pattern, r.group)) >= r.least) if r.least else None
        text = F.col("text") if test is None else F.when(test, F.col("text")).otherwise(F.lit(""))
        all_spans.append(matches(text, r.pattern, r.kind, order, keep, test))
    return both.select("doc_id", "text", by_start(F.concat(*all_spans)).alias("spans"))


def digest(found: DataFrame, rules=RULES) -> DataFrame:
    """The counts and digests of ``find``'s rows."""
    base = [r.kind for r in rules if r.base]
    own: Column = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in base], F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with each secret in text replaced by [kind]; n_chars, if there, follows. Overlapping spans go as one, under the first kind.

    Rows and other columns stay as they are; a null text stays null.
    """
    id_, text_, spans_, clean_ = (helper(x, docs) for x in ("id", "text_", "spans", "clean"))
    spans = find(docs, rules).where(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("text").alias(text_), F.col("spans").alias(spans_)).dropDuplicates([id_, text_])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substring(F.col(text_), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    clean = F.aggregate(spans_, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_), acc["at"] + 1, F.length(text_))))
    changed = spans.select(id_, text_, clean.alias(clean_))
    both = docs.join(changed, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col("text") == F.col(text_)), "left")
    text = F.coalesce(clean_, "text")
    return both.select(*[text.alias("text") if c == "text" else F.when(F.col(clean_).isNull(), F.col("n_chars")).otherwise(F.length(clean_)).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes])


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))

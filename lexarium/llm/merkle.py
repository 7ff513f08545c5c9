"""A Merkle manifest of a dataset: one tree per source, a tree over the sources' roots, and for each row the siblings that lead to the root.

Every level is a table of nodes (key, i, n, d): the i-th of n nodes of a tree and its digest. Over it run lag and lead columns of the
fixed offsets 1 to 15, masked by a node's slot and the length of its run; they are the siblings. The row of a run's first child hashes
the parent. Windows are over (key, block of whole runs), so a source that holds most rows is many groups. Positions come from a sort by
range: counts of (key, range) add up to where each range starts. Digests are kept as 32 bytes and hashed as hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import settle, table

FAN = 16
#: Nodes of a window's group: whole runs, so that a run is never cut.
BLOCK = FAN * 64
PATH = "array<struct<before:binary,after:binary>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(digests: Column) -> Column:
    """sha256 of the hex text of concatenated digests, as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row, as bytes: each field `-` if null, else its UTF-8 length, `:` and its value."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256))


def _placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their position i (from 0) among the n rows of their key, in the order of ``by``."""
    ranges = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(ranges, "key", *by).withColumn("part", F.spark_partition_id()))
    of_key = Window.partitionBy("key")
    starts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m")).select(
        "key", "part", F.coalesce(F.sum("m").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("m").over(of_key).alias("n"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("key", "part").orderBy(*by)) - 1)
    return own.join(starts, ["key", "part"]).withColumn("i", F.col("start") + F.col("own")).drop("part", "start", "own", *by)


def _sided(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the digests of the siblings before and after each."""
    w = Window.partitionBy("key", F.floor(F.col("i") / BLOCK)).orderBy("i")
    slot = F.col("i") % FAN
    length = F.least(F.lit(FAN), F.col("n") - F.col("i") + slot)
    none = F.lit(bytearray())
    before = [F.when(slot >= k, F.lag("d", k).over(w)).otherwise(none) for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("d", k).over(w)).otherwise(none) for k in range(1, FAN)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The tables of all levels, from the leaves to one node a key. A key that is done early keeps its one node as it is."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        digest = F.when(F.col("n") > 1, _hash(F.concat("d", "after"))).otherwise(F.col("d"))
        first = _sided(levels[-1].select("key", "i", "n", "d")).where(F.col("i") % FAN == 0)
        up = first.select("key", F.floor(F.col("i") / FAN).alias("i"), F.ceil(F.col("n") / FAN).alias("n"), digest.alias("d"))
        levels.append(settle(up))
    return levels


def _paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves with the columns of ``ends`` (key, path, ...), their path being theirs up to the key's root and then that of ``ends``."""
    paths = levels[-1].join(ends, "key")
    for nodes in reversed(levels[:-1]):
        above = paths.select("key", F.col("i").alias("run"), *[c for c in ends.columns if c != "key"])
        here = _sided(nodes).withColumn("run", F.floor(F.col("i") / FAN))
        step = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array()).cast(PATH)
        paths = here.join(above, ["key", "run"]).withColumn("path", F.concat(step, "path")).drop("before", "after", "run")
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give, as bytes."""
    return F.aggregate(path, leaf, lambda d, x: _hash(F.concat(x["before"], d, x["after"])))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root (bytes), path: array of (before, after), the siblings of each level from the leaf to the root.

    ``changed``: a column on ``docs`` that is carried along, such as the leaf of another state of the row. Null fields, null sources and null ids count as
    values of their own; sources are ordered null first, then by their bytes. Rows of one source with one doc_id follow by their leaf; rows that
    are equal in all fields are leaves of their own. Columns other than documents' five don't matter. An empty table has no root and gives no row.
    """
    own = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("d"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    own = settle(own.withColumn("row", F.monotonically_increasing_id()))
    by = own.select("*", F.col("doc_id").alias("_id"), F.col("d").alias("_d"))
    trees = _levels(settle(_placed(by, ["_id", "_d", "row"])))
    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("key").alias("_source"), "d")
    top = _levels(settle(_placed(subroots, ["_source"])))
    root = top[-1].select("key", F.lit([]).cast(PATH).alias("path"), F.col("d").alias("root"))
    ends = settle(_paths(top, root).select(F.col("source").alias("key"), "path", "root", F.col("d").alias("subroot")))
    return _paths(trees, ends).select("doc_id", F.col("d").alias("leaf"), "subroot", "root", "path", "changed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.translate("text", UPPER, LOWER))
    known = manifest(docs, F.when(hit, lowered))
    found = known.withColumn("folded", folded(F.coalesce("changed", "leaf"), F.col("path")))
    hex_ = lambda c: F.lower(F.hex(c))
    siblings = F.array_join(F.transform("path", lambda x: hex_(F.concat(x["before"], x["after"]))), "")
    return found.select(
        "doc_id", *[hex_(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(siblings, 256).alias("proof_sha256"),
        hex_("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql(below: int = 5, above: int = 4) -> str:
    """SQL with so many levels of the sources' trees and of the tree over them."""
    field = lambda c: f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    frame = lambda rows: f"coalesce(string_agg(d, '') over (partition by key, i // {FAN} order by i rows between {rows}), '')"

    def tree(name: str, levels: int) -> list[str]:
        ctes = []
        for k in range(levels):
            ctes.append(f"{name}{k}s as (select *, {frame('unbounded preceding and 1 preceding')} as b, {frame('1 following and unbounded following')} as a from {name}{k})")
            ctes.append(f"{name}{k + 1} as (select key, i // {FAN} as i, (n + {FAN - 1}) // {FAN} as n, case when n = 1 then min(d) else sha256(string_agg(d, '' order by i)) end as d from {name}{k} group by key, i // {FAN}, n)")
        return ctes

    steps = [(f"l{k}", f"l{k}s", "x.key", f"x.i // {FAN**k}") for k in range(below)] + [(f"t{k}", f"t{k}s", "1", f"y.i // {FAN**k}") for k in range(above)]
    proof = " || ".join(f"{name}.b || {name}.a" for name, *_ in steps)
    joins = " ".join(f"join {t} {name} on {name}.key = {key} and {name}.i = {i}" for name, t, key, i in steps)
    sides = ", ".join(f"{name}.b as {name}b, {name}.a as {name}a, {name}.n as {name}n" for name, *_ in steps)
    folds, at, v = [], "p", "coalesce(bad, d)"
    for k, (name, *_) in enumerate(steps):
        folds.append(f"f{k} as (select *, case when {name}n = 1 then {v} else sha256({name}b || {v} || {name}a) end as v{k} from {at})")
        at, v = f"f{k}", f"v{k}"
    return f"""
with steps as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)),
crcs as (select list(v order by i) as t from steps),
numbered as (select d.*, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)) as bytes, t from documents d, crcs),
marked as (select *, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(t[cast(xor(c, x) & 255 as integer) + 1], c >> 8)), 4294967295) as crc from numbered),
l0 as (select case when source is null then '' else '=' || source end as key, doc_id, {leaf('text')} as d,
  case when crc % 5 = 0 then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as bad,
  row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n from marked),
{", ".join(tree("l", below))},
t0 as (select 1 as key, key as source, row_number() over (order by key) - 1 as i, count(*) over () as n, d from l{below}),
{", ".join(tree("t", above))},
p as (select x.doc_id, x.d, x.bad, y.d as subroot, r.d as root, sha256({proof}) as proof_sha256, {sides}
  from l0 x join t0 y on y.source = x.key {joins} cross join t{above} r),
{", ".join(folds)}
select doc_id, d as leaf, subroot, root, proof_sha256, {v} as folded_root, {v} = root as verified from {at}
"""


SQL = _sql()

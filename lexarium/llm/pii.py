"""Personal data by bootstrapped contextual extraction, with SQL functions only.

Base kinds are found by their patterns. Every token that looks like an identifier (it has four digits or an @) and stands after a word is
an instance of lexical patterns: the word before it; the two words before it; the word before and the shape of the token (its runs of
digits and letters); the word before and the word after. The graph joins patterns with instances, weighted by how often they
meet. Seeds are the instances that are base entities. In each round a pattern's score is the share of its
occurrences whose instance is believed, and an instance's score is one minus the product of its patterns' doubts. Patterns of
high score with enough different seeds find further instances, whose spans are added as kind ``context``. Instances that are believed
count as seeds in the rounds after; rounds go on until no more patterns or instances are believed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_text, join_split, settle, table
from .spans import SPAN, THEN, by_kind, count_of, matches, written

#: Rounds of scoring, at least.
ROUNDS = 2
#: Score from which a pattern or an instance is believed, and different believed instances that a pattern needs.
CONFIDENT = 0.9
SEEDS = 3
#: A pattern is doubted by this many unseen occurrences that are nothing.
PRIOR = 1.0
KINDS = ("email", "ip", "card", "phone")
#: Java forms of the base patterns. A match can't begin inside a run that an earlier start would have taken whole,
#: unless that start was in the match before: this keeps very long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9]+(?:[\x20-][0-9]+)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: One or two words, up to three other characters, and a token that looks like an identifier.
_TOKEN = r"[\p{L}\p{N}+][\p{L}\p{N}@._%+-]*+"
IN_CONTEXT = r"(?<![\p{L}\p{N}])(?:\p{L}++\x20)?\p{L}++[:#=\x20(]{1,3}+(?=[\p{L}._%+-]*+[\p{N}@])" + _TOKEN
#: The next word after a token.
AFTER = r"^[\x20,;:.)]{1,3}(\p{L}++)(?!\p{N})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Every second digit from the right doubled, its digits added: the sum is a multiple of ten."""
    d = F.split(F.reverse(_digits(value)), "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 1, (x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return total % 10 == 0


def _card(value: Column) -> Column:
    return F.when(F.length(_digits(value)).between(16, 19), _luhn(value)).otherwise(False)


def _ip(value: Column) -> Column:
    """Each part without leading zeros has up to three digits and is at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind, then start."""
    has_digit = text.rlike("[0-9]")
    return F.concat(
        matches(text, EMAIL, "email", 0, only_if=F.contains(text, F.lit("@"))),
        matches(text, IP, "ip", 1, _ip, has_digit & F.contains(text, F.lit("."))),
        matches(text, CARD, "card", 2, _card, text.rlike("[0-9][0-9\\x20-]{14}")),
        matches(text, PHONE, "phone", 3, _phone, F.contains(text, F.lit("+"))),
    )


def confident_patterns(seen: DataFrame) -> DataFrame:
    """(word, score, n) of the patterns to believe and their occurrences, after rounds over the graph of ``seen`` until the patterns and instances believed stay.

    Scores and beliefs never fall, so these sets only grow. Edges are first counted, so a word or token that is everywhere is a row for each partner;
    edges of such a word or token meet its score by broadcast (``join_split``), the others by hash.
    """
    edges = settle(seen.groupBy("word", "token").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("seed").cast("int")).alias("seed")))
    total = edges.count()
    belief = settle(edges.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max("seed").cast("double").alias("seed"))).withColumn("belief", F.col("seed"))
    was, turn = None, 0
    while True:
        scored = join_split(edges.drop("seed"), belief.select("token", "belief", "n"), "token", total).groupBy("word").agg(
            (F.sum(F.col("times") * F.col("belief")) / (F.sum("times") + F.lit(PRIOR))).alias("score"), F.sum((F.col("belief") >= CONFIDENT).cast("int")).alias("seeds"),
            F.count(F.lit(1)).alias("n"), F.sum("times").alias("occurs"),
        )
        patterns = settle(scored.where((F.col("seeds") >= SEEDS) & (F.col("score") >= CONFIDENT)))
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.99)))))
        reached = join_split(edges.select("word", "token"), patterns.select("word", "score", "n"), "word", total).groupBy("token").agg((F.lit(1.0) - doubt).alias("reach"))
        belief = settle(belief.drop("belief").join(reached, "token", "left").withColumn("belief", F.greatest("seed", F.coalesce(F.col("reach"), F.lit(0.0)))).drop("reach"))
        now = patterns.count(), belief.where(F.col("belief") >= CONFIDENT).count()
        turn += 1
        if now == was and turn >= ROUNDS:
            break
        was = now
    return patterns.select("word", "score", F.col("occurs").alias("n"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, order, stop, kind, value; by kind, then start) of each row: base kinds, and ``context`` discoveries.

    Null text counts as empty. Rows that repeat an id are searched one by one. Values of discoveries are the tokens.
    """
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs).select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = rows.select("row", "doc_id", "text", base_spans(F.col("text")).alias("spans"))
    hits = matches(F.col("text"), IN_CONTEXT, "context", len(KINDS), only_if=F.col("text").rlike("[0-9@]"), after=AFTER)
    base = settle(found.select("row", "doc_id", "spans", hits.alias("hits")))
    seen = settle(_occurrences(base))
    known = confident_patterns(seen)
    new = join_split(seen, known, "word", seen.count()).where(~F.col("seed")).groupBy("row").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("order"), "stop", F.lit("context").alias("kind"), F.col("token").alias("value"))).cast(SPAN).alias("new")
    )
    both = base.join(new, "row", "left")
    return both.select("doc_id", by_kind(F.concat("spans", F.coalesce("new", F.lit([]).cast(SPAN)))).alias("spans"))


def _occurrences(base: DataFrame) -> DataFrame:
    """(row, word, token, start, stop, seed): tokens that look like identifiers, under each of their patterns; seed: a base span overlaps."""
    each = base.select("row", "spans", F.explode("hits").alias("hit"))
    hit, then = F.split("hit.value", THEN, 2)[0], F.split("hit.value", THEN, 2)[1]
    token = F.regexp_extract(hit, f"({_TOKEN})$", 1)
    each = each.select("row", "spans", F.col("hit.stop").alias("stop"), hit.alias("hit"), token.alias("token"), F.lower(then).alias("right"))
    looks = (F.length(_digits(F.col("token"))) >= 4) | F.contains("token", F.lit("@"))
    each = each.where(looks & (F.length("token") >= 6)).withColumn("start", F.col("stop") - F.length("token"))
    words = F.lower(F.regexp_extract(F.expr("substring(hit, 1, length(hit) - length(token))"), r"^((?:\p{L}+\x20)?\p{L}+)", 1))
    each = each.select("*", words.alias("words")).select("*", F.element_at(F.split("words", " "), -1).alias("left"))
    shape = F.regexp_replace(F.regexp_replace("token", r"\p{L}+", "A"), "[0-9]+", "9")
    two, after = F.when(F.contains("words", F.lit(" ")), F.col("words")), F.when(F.col("right") != "", F.concat_ws(" _ ", "left", "right"))
    patterns = F.array_compact(F.array(F.col("left"), two, F.concat_ws(" | ", F.col("left"), shape), after))
    seed = F.exists("spans", lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start")))
    return each.select("row", F.explode(patterns).alias("word"), "token", "start", "stop", seed.alias("seed"))


def digest(found: DataFrame) -> DataFrame:
    own = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{k}") for k in KINDS], F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents")))

"""Topics, law per topic, request rows for a model, and chat context."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache, reduce
from hashlib import md5
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import terms as W
from ..functions.cleaning import computed
from ..functions.text import once
from ..sources.shared import dealt, settle
from .contracts import EVALUATION
from .search import knn, ranked


#: Rows of a batch that goes back with vectors.
PART = 2048


def embed(df: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", batch: int = 256, double: bool = False) -> DataFrame:
    """df with ``embedding``: float32 vectors of length 1. ``encoder`` makes the model once a task; null text counts as empty; zero vectors stay.

    Of a batch of rows each distinct text is encoded once. double: vectors of 64-bit numbers, for scores that are compared beyond six digits.
    """
    schema = StructType([*df.schema, StructField("embedding", ArrayType(DoubleType() if double else FloatType()))])
    kind = np.float64 if double else np.float32

    def run(batches):
        model = encoder()
        for b in batches:
            coded = b.column(text).fill_null("").dictionary_encode()
            texts = coded.dictionary.to_pylist()
            made = [np.asarray(model(texts[start : start + batch]), kind) for start in range(0, len(texts), batch)]
            v = np.concatenate(made) if made else np.zeros((0, 0), kind)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            at = coded.indices.to_numpy(zero_copy_only=False)
            for start in range(0, b.num_rows, PART):
                part, own = b.slice(start, PART), v[at[start : start + PART]]
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(own.reshape(-1)))], names=[*part.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


#: Features whose signs a task keeps.
KEPT_FEATURES = 1 << 16


def hashed_ngrams(dim: int = 128, n: int = 2) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder for ``embed`` that needs no model: of each run of up to n lower-cased words the bits of an MD5 are signs in ``dim`` directions, summed up.

    This is a random projection of the counts of these runs, so texts that share many have a high inner product. dim: a multiple of 128.
    """
    if dim % 128:
        raise ValueError(f"dim must be a multiple of 128, not {dim}")

    def make() -> Callable[[list[str]], np.ndarray]:
        @lru_cache(maxsize=KEPT_FEATURES)
        def signs(feature: str) -> np.ndarray:
            digests = b"".join(md5(f"{k}{feature}".encode() if k else feature.encode(), usedforsecurity=False).digest() for k in range(dim // 128))
            return np.unpackbits(np.frombuffer(digests, np.uint8)).astype(np.float32) * 2 - 1

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, text in zip(out, texts, strict=True):
                words = text.lower().split()
                for feature, times in Counter(" ".join(words[i : i + m]) for m in range(1, n + 1) for i in range(len(words) - m + 1)).items():
                    row += times * signs(feature)
            return out

        return encode

    return make


def text_neighbours(queries: DataFrame, kb: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], k: int = 5, min_score: float = 0.6) -> DataFrame:
    """query_id, vec_id, rank, score: the exact top k of ``knn`` for texts. queries: query_id, text. kb: vec_id, text. Null texts don't count.

    Rows that repeat a query's id are one query. Rows of one text have one vector, so only the k smallest ids of each text can be in an answer, and a text that many queries share is searched once.
    Vectors have 64-bit numbers, so that scores which agree to six digits are the same whatever the order of the sums.
    """
    nth = F.row_number().over(Window.partitionBy("text").orderBy("vec_id"))
    kept = kb.where("text is not null").select("vec_id", "text").withColumn("_n", nth).where(F.col("_n") <= k).drop("_n")
    asked = settle(queries.where("text is not null").select("text").distinct().withColumn("_asked", F.monotonically_increasing_id()))
    vectors = settle(embed(kept, encoder, double=True).drop("text"))
    hits = knn(embed(asked.withColumnRenamed("_asked", "query_id"), encoder, double=True).drop("text"), vectors, k, min_score)
    own = queries.join(asked, "text").select("query_id", "_asked")
    found = own.join(hits.withColumnRenamed("query_id", "_asked").drop("rank"), "_asked").select("query_id", "vec_id", "score")
    return ranked(found, k)


def shortest(words: list[str]) -> list[str]:
    """The words that have no other of them inside: a text with any of ``words`` has one of these."""
    return [w for w in words if not any(v in w for v in words if v != w)]


def topics_of(text: Column) -> Column:
    """All topics, in order, of which a word is in the text; words may be inside others."""
    shown = lambda low: F.array_compact(F.array(*[F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in shortest(words)]), F.lit(t)) for t, words in W.TOPICS.items()]))
    return once(F.lower(text), shown)


def detect_topics(texts: DataFrame, key: str = "contract_id") -> DataFrame:
    """key, topic."""
    return texts.select(key, F.explode(topics_of(F.col("text"))).alias("topic"))


def any_of(low: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text. The first part of several words is looked for once, and they only where it is."""
    alike: dict[str, list[str]] = {}
    for w in shortest(words):
        alike.setdefault(w.split(" ")[0], []).append(w)
    has = lambda w: F.contains(low, F.lit(w))
    return reduce(or_, [has(ws[0]) if len(ws) == 1 else has(part) & reduce(or_, map(has, ws)) for part, ws in alike.items()])


def told_once(text: Column) -> Column:
    """The text's sentences, each once: a word without a full stop is in it if and only if it is in the text."""
    return F.array_join(F.array_distinct(F.split(text, r"\.")), ".")


def clause_topic(clauses: DataFrame) -> DataFrame:
    """The clauses with the first topic in order and its first word in order that is in the text; ``general`` and '' if none."""
    low = F.col("_low")
    first = [F.when(any_of(low, words), F.struct(F.lit(t).alias("topic"), F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]).alias("keyword"))) for t, words in W.TOPICS.items()]
    none = F.struct(F.lit(W.GENERAL).alias("topic"), F.lit("").alias("keyword"))
    found = computed(computed(clauses, _low=F.lower(told_once(F.col("text")))), _t=F.coalesce(*first, none))
    return found.withColumns({"topic": F.col("_t.topic"), "keyword": F.col("_t.keyword")}).drop("_t", "_low")


def _once(hits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of each key with texts that differ in their first 200 characters, and their place ``pos`` from 1."""
    same = Window.partitionBy(key, F.substring("text", 1, 200)).orderBy(*order)
    first = hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def law_for_topics(queries: DataFrame, kb: DataFrame, k: int = 5, min_score: float = 0.6) -> DataFrame:
    """topic, pos, vec_id, text, score: for each topic the top k of its queries, in query order, distinct by 200 characters, 2k at most.

    queries: query_id, topic, qpos, embedding. kb: vec_id, embedding, text. The hits, k a query, join back to the texts.
    """
    hits = knn(queries, kb, k, min_score).join(queries.select("query_id", "topic", "qpos"), "query_id").join(kb.select("vec_id", "text"), "vec_id")
    return _once(hits, "topic", ["qpos", "rank", "vec_id"]).where(F.col("pos") <= 2 * k).select("topic", "pos", "vec_id", "text", "score")


def merge_law(contract_topics: DataFrame, law: DataFrame, tasks: int | None = None) -> DataFrame:
    """contract_id, pos, topic, vec_id, text: law of all topics of a contract, topics in order, distinct by 200 characters.

    What a contract gets depends on its set of topics alone, so law is merged once for each set that occurs, and these few lists (law_for_topics gives 2k rows a topic)
    are broadcast. tasks: over how many the topics are dealt by contract, by default the number of shuffle partitions.
    """
    order = F.create_map(*[F.lit(x) for i, t in enumerate(W.TOPICS) for x in (t, i)])
    by_contract = contract_topics.repartition(tasks, "contract_id") if tasks else contract_topics
    sets = settle(by_contract.groupBy("contract_id").agg(F.array_sort(F.collect_set("topic")).alias("_set")))
    each = sets.select("_set").distinct().select("_set", F.explode("_set").alias("topic"))
    own = each.join(law.withColumnRenamed("pos", "_p"), "topic").withColumn("_o", order[F.col("topic")])
    merged = _once(own, "_set", ["_o", "_p", "vec_id"]).select("_set", "pos", "topic", "vec_id", "text")
    return sets.join(F.broadcast(merged), "_set").select("contract_id", "pos", "topic", "vec_id", "text")


def format_context(law: DataFrame, key: str = "topic") -> DataFrame:
    """key, context: for each piece of law in order of pos a head (number, title, status, dates) and its text, 3000 characters at most.

    Pieces of one number and effective date share the head of the first. Rows that are dealt by key already aren't shuffled again.
    """
    doc = Window.partitionBy(key, "doc_number", "effective_date").orderBy("pos")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in W.STATUS.items() for x in kv])[F.col("status_flag")], F.lit(W.STATUS_UNKNOWN))
    flag = F.coalesce(F.col("status_flag").cast("string"), F.lit("None"))
    date = lambda s, c: F.when(blank(c) != "", F.concat(F.lit(s), F.col(c))).otherwise("")
    head = F.concat(F.lit("\n--- "), blank("doc_number"), F.lit(" - "), blank("title"), F.lit(" ---\n    Status: "), label, F.lit(" (flag="), flag, F.lit(")"), date(" | Hiệu lực từ: ", "effective_date"), date(" | Hết hiệu lực: ", "expiry_date"))
    each = law.withColumn("_h", F.first(head).over(doc)).select(key, "pos", F.concat_ws("\n", "_h", F.substring("text", 1, 3000)).alias("line"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("context"))


def clause_prompts(clauses: DataFrame, contexts: DataFrame, template: str = "{clause}\n\n{law}") -> DataFrame:
    """contract_id, pos, clause_number, topic, prompt: the clause (5000 characters at most) and its topic's law (4000 at most) in the template.

    contexts: a row a topic. These few rows are broadcast, so that clauses aren't dealt by topic, of which one has most.
    """
    cut = clause_topic(clauses.withColumn("text", F.substring("text", 1, 5000)))
    contexts = F.broadcast(contexts.select("topic", F.substring("context", 1, 4000).alias("context")))
    law = F.coalesce("context", F.lit(W.NO_LAW))
    parts = [p for piece in template.split("{clause}") for p in (F.col("text"), *_filled(piece, law))][1:]
    return cut.join(contexts, "topic", "left").select("contract_id", "pos", "clause_number", "topic", F.concat(*parts).alias("prompt"))


def _filled(piece: str, law: Column) -> list[Column]:
    return [p for s in piece.split("{law}") for p in (law, F.lit(s))][1:]


def contract_prompts(contracts: DataFrame, contexts: DataFrame, tasks: int | None = None) -> DataFrame:
    """contract_id, prompt: the text, 10000 characters at most, and the contract's merged law. Both are dealt by contract over ``tasks``, see shared.dealt."""
    own = dealt(contracts.select("contract_id", F.substring("text", 1, 10000).alias("text")), "contract_id", "text", tasks)
    return own.join(contexts, "contract_id", "left").select("contract_id", F.concat_ws("\n\n", F.substring("text", 1, 10000), F.coalesce("context", F.lit(W.NO_LAW))).alias("prompt"))


def risk_arrays(responses: DataFrame) -> DataFrame:
    """contract_id, pos and fields of each risk in a model's JSON array, fenced or bare; texts that aren't such an array as a whole give none."""
    fence = F.regexp_extract("response", r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fence != "", fence).otherwise(F.col("response"))
    # in an object of its own, since what follows an array would be passed over
    held = F.from_json(F.concat(F.lit('{"x":'), F.when(F.trim(text).startswith("["), text), F.lit("}")), f"x array<struct<{EVALUATION}>>")
    each = responses.select("contract_id", F.posexplode(held["x"]).alias("pos", "r"))
    return each.select("contract_id", "pos", "r.*")


def top_actions(recs: DataFrame, n: int = 5) -> DataFrame:
    """contract_id, pos, issue, severity: the first n actions of each recommendation, as info."""
    return recs.select("contract_id", F.posexplode(F.slice("actions", 1, n)).alias("pos", "issue"), F.lit("info").alias("severity"))


def evaluations_payload(evals: DataFrame) -> DataFrame:
    """contract_id, json: all evaluations as an array in clause order."""
    rest = [c for c in evals.columns if c not in ("contract_id", "pos")]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*rest).alias("e"))))
    return evals.groupBy("contract_id").agg(F.to_json(F.transform(rows, lambda x: x["e"])).alias("json"))


def chat_context(questions: DataFrame, own: DataFrame, law: DataFrame, history: DataFrame) -> DataFrame:
    """question_id, contract_context (8000 characters at most), legal_context (3000), history, question.

    own, law: question_id, rank, text. history: question_id, history.
    """

    def joined(hits, name):
        rows = F.array_sort(F.collect_list(F.struct("rank", "text")))
        return hits.groupBy("question_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias(name))

    out = questions.join(joined(own, "_c"), "question_id", "left").join(joined(law, "_l"), "question_id", "left").join(history, "question_id", "left")
    return out.select(
        "question_id",
        F.substring(F.coalesce("_c", F.lit("Không có dữ liệu hợp đồng.")), 1, 8000).alias("contract_context"),
        F.substring(F.coalesce("_l", F.lit(W.NO_LAW)), 1, 3000).alias("legal_context"),
        F.coalesce("history", F.lit("Không có lịch sử.")).alias("history"),
        "question",
    )


def source_clauses(hits: DataFrame) -> DataFrame:
    """question_id, clauses: the clause numbers that aren't empty, distinct, in order of text."""
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_set(F.nullif("clause_number", F.lit("")))).alias("clauses"))

"""License scans by a positional index of rare words.

Templates are licence notices in which the mandatory key phrases stand in brackets. The index has a posting (template, place) for each word of a
key phrase. Two passes over the texts: the first counts the documents that hold each licence word; the second looks up, for each file, its
licence words from the highest IDF down until each template whose key words the file has is reached by two of them, intersects what their
postings say about the template's place in the file, and verifies the key phrases there, word by word. Files that lack a key word
of each template are done after a set operation.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import arrow_map, batch_of, table

# Phrases and labels that the contract names.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label and notice, lower-cased and in words; key phrases in brackets, all of which must stand in their places.
TEMPLATES = [
    ("mit", "released [under the mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the [apache license version 2] 0"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("gpl-2", "this work is licensed under the [gnu general public license version 2]"),
    ("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    ("lgpl-3", "licensed under the [gnu lesser general public license version 3]"),
    ("agpl-3", "licensed under the [gnu affero general public license version 3]"),
    ("mpl-2", "subject to the terms of the [mozilla public license v 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted [provided that the following conditions are met]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("all-rights-reserved", "[all rights reserved]"),
]
#: A-Z to a-z; all that isn't part of a word to a space.
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(content: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of a-z (A-Z lower-cased), 0-9 and all characters beyond ASCII."""
    return content.translate(_WORDS).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    #: (first place, words) of each key phrase.
    keys: list[tuple[int, list[bytes]]]


def template(label: str, notice: str) -> Template:
    words: list[bytes] = []
    keys = []
    for k, part in enumerate(notice.replace("]", "[").split("[")):
        own = words_of(part.encode())
        if k % 2:
            keys.append((len(words), own))
        words += own
    return Template(label, words, keys)


class Index:
    """Templates, their postings by key word, and the weight of each licence word."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float]):
        self.templates, self.idf = templates, idf
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, x in enumerate(templates):
            for first, phrase in x.keys:
                for k, word in enumerate(phrase):
                    self.postings.setdefault(word, []).append((t, first + k))
        self.needs = [frozenset(w for _, phrase in x.keys for w in phrase) for x in templates]

    def lookups(self, present: set[bytes]) -> dict[bytes, list[tuple[int, int]]]:
        """The postings of a file's rarest licence words, as many of these as reach each possible template twice (or by its only word)."""
        wanted = {t: min(2, len(need)) for t, need in enumerate(self.needs) if need <= present}
        out: dict[bytes, list[tuple[int, int]]] = {}
        for word in sorted(present & self.postings.keys() if wanted else (), key=lambda w: (-self.idf.get(w, 0.0), w)):
            out[word] = [p for p in self.postings[word] if p[0] in wanted]
            for t in {t for t, _ in out[word]}:
                wanted[t] -= 1
            if max(wanted.values()) <= 0:
                break
        return out

    def found(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, place of its first word) wherever all its key phrases stand; the place may be before the file's first word."""
        lookups = self.lookups(set(words) & self.postings.keys())
        places: dict[bytes, list[int]] = {w: [] for w in lookups}
        for i, w in enumerate(words) if lookups else ():
            if w in places:
                places[w].append(i)
        starts: dict[int, set[int]] = {}
        for word, postings in lookups.items():
            for t, offset in postings:
                own = {i - offset for i in places[word]}
                starts[t] = starts[t] & own if t in starts else own
        stands = lambda s, t: all(s + k >= 0 and words[s + k : s + k + len(phrase)] == phrase for k, phrase in self.templates[t].keys)
        return [(t, s) for t, own in starts.items() for s in sorted(own) if stands(s, t)]

    def share(self, words: list[bytes], t: int, start: int) -> float:
        """How much of a template's weight stands in its place."""
        weights = [(self.idf.get(w, 0.0), 0 <= start + k < len(words) and words[start + k] == w) for k, w in enumerate(self.templates[t].words)]
        total = sum(x for x, _ in weights)
        return sum(x for x, there in weights if there) / total if total else 1.0


def idf_of(docs: DataFrame, templates: list[Template]) -> dict[bytes, float]:
    """ln((1 + documents) / (1 + those that hold the word)) of each word of the templates; as many rows come to the driver as there are words."""
    known = frozenset(w for x in templates for w in x.words)

    def each(batch):
        n = Counter(w for content in _contents(batch) for w in known.intersection(words_of(content)))
        yield batch_of(word=pa.array([*n, None], pa.binary()), n=pa.array([*n.values(), batch.num_rows], pa.int64()))

    rows = arrow_map(docs.select("text"), each, "word binary, n long").groupBy("word").sum("n").collect()
    n = {None if r[0] is None else bytes(r[0]): r[1] for r in rows}
    return {w: math.log((1 + n.get(None, 0)) / (1 + n.get(w, 0))) for w in known}


def _contents(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(batch.schema.get_field_index("text")):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs``.

    n_base counts all places of the phrases of BASE, first_word and last_word are the smallest and largest word where one begins (null without
    one). labels has base_labels and those of all other templates that stand in the text, distinct, sorted and comma-joined. score is the largest share of
    a template's weight that stands in its place, 0 without a template, rounded to 6 digits. Null text counts as empty; an empty table gives no row; rows
    that repeat an id are documents of their own; columns other than doc_id and text don't matter. ``templates``: as TEMPLATES; those
    of the phrases of BASE must be among them for these to be found.
    """
    parsed = [template(*x) for x in templates or TEMPLATES]
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    index = Index(parsed, idf_of(docs, parsed))
    base = {tuple(words_of(phrase.encode())) for phrase in BASE}

    def each(batch):
        rows = []
        for content in _contents(batch):
            words = words_of(content)
            found = index.found(words)
            places = {(s + k, tuple(phrase), index.templates[t].label) for t, s in found for k, phrase in index.templates[t].keys if tuple(phrase) in base}
            begins = [p[0] for p in places]
            rows.append((
                len(words), len({p[:2] for p in places}), min(begins, default=None), max(begins, default=None), ",".join(sorted({p[2] for p in places})),
                ",".join(sorted({index.templates[t].label for t, _ in found})), round(max((index.share(words, t, s) for t, s in found), default=0.0), 6)))
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield batch_of(doc_id=batch.column(0), **{c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(names, kinds, strict=True))})

    return arrow_map(docs, each, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values, keys = [], []
    for t, x in enumerate(template(*x) for x in TEMPLATES):
        inside = {first + k for first, phrase in x.keys for k in range(len(phrase))}
        values += [f"({t}, {k}, '{w.decode()}', {k in inside})" for k, w in enumerate(x.words)]
        keys.append(f"({t}, '{x.label}', {len(inside)}, {x.keys[0][0]}, {' '.join(w.decode() for w in x.keys[0][1]) in BASE})")
    return f"""
with tw(t, o, word, is_key) as (values {", ".join(values)}),
tk(t, label, n_keys, first_key, is_base) as (values {", ".join(keys)}),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
tok as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
df as (select word, count(distinct doc_id) as n from tok where word in (select word from tw) group by word),
idf as (select word, ln((1 + (select count(*) from d)) / (1 + coalesce(n, 0))) as weight from (select distinct word from tw) left join df using (word)),
whole as (select t, sum(weight) as weight from tw join idf using (word) group by t),
placed as (select doc_id, t, i - o as s, sum(weight) as weight, count(*) filter (is_key) as n from tok join tw using (word) join idf using (word) group by doc_id, t, i - o),
hit as (select doc_id, label, s + first_key as place, first_key, is_base, case when whole.weight > 0 then placed.weight / whole.weight else 1.0 end as share from placed join tk using (t) join whole using (t) where n = n_keys),
per as (select doc_id, count(distinct (place, label)) filter (is_base) as n_base, min(place) filter (is_base) as first_word, max(place) filter (is_base) as last_word,
  string_agg(distinct label, ',' order by label) filter (is_base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from hit group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(round(score, 6), 0.0) as score
from d left join per using (doc_id)
"""


SQL = _sql()

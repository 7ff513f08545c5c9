"""Secrets and personal data against plain versions over a whole small table, and hard texts."""

import hashlib
import re

import pytest

from lexarium.llm import pii, secrets, spans

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "é" * 50 + ' Password: "hunter22", x', "token=abc token=abcdefgh token = 'a.b-c_d=' apikey:123456 API_KEY = zzzzzz", "AKIA" + "A1" * 8, "AKIA" + "A1" * 7 + "B", "xAKIAxAKIA" + "Z" * 30,
    "0a" * 12, "0a" * 11 + "b", "-".join(["deadbeef" * 4] * 700), "KKIA tokenſ = abcdef", "secret = " + "x" * 3000, "a.b@c a@b.c.d, x@y.z- @q.r a@b..c a%+-@b-c.de.f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 4111  1111", "+1 (555) 555-0100 +12 +1-2-3-4-5-6-7-8 ++49 30 123456 +1234567890123456", "+1 555 0100 4111111111111111", "x" * 20_000 + " 10.0.0.1",
]


def base_secrets(t):
    """The contract's rules, word for word."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(t):
    n = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(2, m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(n(m[0])) <= 19 and luhn(n(m[0]))]
    return found + [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(n(m[0])) <= 15]


def sha(written):
    return hashlib.sha256(",".join(written).encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return table.union(spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))


def test_base_secrets(spark, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = secrets.digest(secrets.find(docs)).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = base_secrets(text[r.doc_id])
        assert r.base_sha256 == sha([f"{k}:{a}:{b}" for a, _, b, k in want]), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[3] == k for w in want) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(r.spans.split(","))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, o, b, k in brute_all(text[r.doc_id]))


def brute_all(t):
    """Every rule on every text, without the index."""
    found = []
    for order, rule in enumerate(secrets.RULES):
        found += [(m.start(), order, m.end(), rule.kind) for m in re.finditer(rule.pattern.replace(r"\Z", r"\z"), t, re.A) if not rule.least or len(m[rule.group]) >= rule.least]
    return sorted(found)


def test_queries_are_necessary():
    """Whatever a rule matches has, without case, the trigrams of its query."""
    samples = {
        "assign": ["PassWord:abcdef", "api_key='zzzzzz"], "access": ["AKIA" + "A" * 16], "private_key": ["-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----"], "hosted_git": ["ghp_" + "a" * 40],
        "chat": ["xoxb-" + "1" * 12], "cloud_key": ["AIza" + "b" * 40], "web_token": ["eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12],
    }
    for rule in secrets.RULES:
        for s in samples.get(rule.kind, []):
            assert re.search(rule.pattern, s) and all(any(g <= secrets._trigrams(s.lower()) for g in options) for options in secrets.trigram_query(rule.pattern))


def test_base_pii(spark, docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = base_pii(text[r.doc_id])
        assert r.base_sha256 == sha([f"{k}:{a}:{b}" for _, a, b, k in want]), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for _, a, b, k in want} <= set(r.spans.split(","))


def test_more_precise_patterns(spark):
    """'number' alone stands before all kinds of things; two words, a shape or the word after tell identifiers from the rest."""
    rows = [f"badge number u{i}{i}7@x.example.org ok" for i in range(10, 40)] + [f"order number 55{i}00 ok" for i in range(100, 200)]
    rows += ["a badge number QX-771234 ok", "an order number 990011 ok"]
    rows += [f"ref 10.{i}.7.{i} zz" for i in range(30)] + [f"ref ZZ{i}44 zz" for i in range(100, 180)] + ["a ref 310.44.7.9999 qq", "a ref ZZ55544 qq"]
    rows += [f"card u{i}{i}8@x.example.org holder" for i in range(10, 40)] + [f"card 77{i} game" for i in range(1000, 1080)] + ["my card KK-00123 holder", "my card 778899 game"]
    found = [[(s.kind, s.value) for s in r.spans if s.kind == "context"] for r in pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    hits = {r: f for r, f in zip(rows, found, strict=True) if f}
    assert hits == {"a badge number QX-771234 ok": [("context", "QX-771234")], "a ref 310.44.7.9999 qq": [("context", "310.44.7.9999")], "my card KK-00123 holder": [("context", "KK-00123")]}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "secret=abcdef12", "s", 3), (1, "secret=abcdef12", "s", 3), (1, None, "t", 4), (None, "secret=abcdef12 x", "t", 5), (2, "plain", "u", 6)], "doc_id long, text string, spans string, id int")
    assert secrets.find(docs).count() == pii.find(docs).count() == 5
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and sorted(str(r.text) for r in masked.collect()) == ["None", "[assign]", "[assign]", "[assign] x", "plain"]
    empty = docs.limit(0)
    assert secrets.find(empty).count() == pii.find(empty).count() == secrets.redact(empty).count() == 0


def test_many_matches_of_one_text(spark):
    text = "é 1.2.3.4;" * 3000
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].spans
    assert [(s.start, s.stop) for s in r] == [(10 * i + 2, 10 * i + 9) for i in range(3000)] and spans.CHUNK < 3000

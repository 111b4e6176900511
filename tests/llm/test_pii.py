import math
import re
from collections import Counter

import pytest

from sparqa.llm import pii

from .helpers import DOCS, documents, odd_texts, prose, with_odd_columns

#: the contract's patterns
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = odd_texts() + [
    "a@b.c.@d.e x@y.zz x@y a.b%+-c@d-e.f-g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 00.0.0.0 1.2.3", "4111 1111 1111 1111-4111111111111111",
    "4012888888881881 4012-8888-8888-1881, 4012 8888 8888 1882", "+1 (555) 010-9999 +12 +1234567 +49.30.1234567- ++1 2345678", "é😀 m@n.o 😀 1.1.1.1 日 +49.30.1234567",
    "9" * 30_000 + " " + "a" * 50_000 + "@" + "b.c" * 5, "+" * 500 + "1 2 3 4 5 6 7 8 9", "a@b.c " * 2_000, "-" * 40_000 + "@x.y",
]


def test_base_spans(spark):
    docs = with_odd_columns(documents(spark, TEXTS))
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == brute(t), i
        assert all(s.value == (t or "")[s.start:s.end] for s in got[i].base)


@pytest.fixture(scope="module")
def planted():
    """A word that stands in texts of one address, far from it too, and in one
    text without; one that stands there and elsewhere; and one in copies of a
    single text only."""
    texts = [f"{prose(s, 40)} Zebulon the baker at zeb@mail.example now {prose(s + 500, 60)} and Zebulon again" for s in range(5)]
    texts += [f"{prose(s, 40)} the baker {prose(s + 1, 30)}" for s in range(100, 160)]
    texts += [f"{prose(77, 10)} Quixotic one@only.example {prose(78, 10)}"] * 6
    return texts + [prose(s, 60) for s in range(200, 300)] + [f"{prose(400, 30)} Zebulon alone {prose(401, 30)}"]


def brute_terms(texts):
    """{term: kind} by the definitions, over lists of distinct terms."""
    address = re.compile(PATTERNS["email"])
    rows = []
    for t in texts:
        t = t or ""
        spans = brute(t)
        terms = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", address.sub(" ", t) if any(k == "email" for k, _, _ in spans) else t)}
        entities = set()
        for k, a, b in spans:
            value = re.sub("[^0-9]", "", t[a:b]) if k in ("card", "phone") else t[a:b].lower()
            entities |= {f"{k}:", f"{k}:{value}"}
        rows.append((t, terms, entities))
    df = Counter(x for _, terms, _ in rows for x in terms)
    n_entity = Counter(e for _, _, entities in rows for e in entities)
    both, where = Counter(), {}
    for t, terms, entities in rows:
        for e in entities:
            for x in terms:
                both[e, x] += 1
                where.setdefault((e, x), set()).add(t)
    out = {}
    for (e, x), n in both.items():
        k, p = len(where[e, x]), n_entity[e] / len(texts)
        if k > 1 and p < 1:
            share = math.log((1 - 1 / k) * (n + p) / (df[x] + 1) / p) / -math.log(p)
            if share >= pii.GENERALISE:
                out[x] = max(out.get(x, ""), "remove" if share >= pii.REMOVE else "generalise")
    return out


@pytest.mark.parametrize("limit", [50_000, 0])
def test_disclosing_terms(spark, planted, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    docs = documents(spark, planted)
    found = {r.term: r.kind for r in pii.disclosures(pii.base_spans(docs)).collect()}
    assert found == brute_terms(planted)
    assert "zebulon" in found and not {"baker", "quixotic"} & set(found)
    got = pii.find_pii(docs).collect()
    assert len(got) == len(planted)
    for r in got:
        text = planted[r.doc_id]
        spans = [(s.start, s.end) for s in r.base]
        want = [(m.start(), m.end(), found[m.group().lower()]) for m in re.finditer(r"[^\W\d_]{3,}", text)
                if m.group().lower() in found and not any(a < m.end() and b > m.start() for a, b in spans)]
        assert sorted((s.start, s.end, s.kind) for s in r.terms) == want


def test_sanitise(spark, planted):
    docs = documents(spark, planted + [None, "mail x@y.zz or 1.2.3.4"])
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[email]" in got[0] and "baker" in got[0]
    assert not any("Zebulon" in (got[i] or "") for i in got)  # far from the address, and in the text without it
    assert got[len(planted)] is None and got[len(planted) + 1] == "mail [email] or [ip]"
    assert all(got[i] == planted[i] for i in range(80, len(planted) - 1))


def test_shapes(spark):
    df = spark.createDataFrame([("Zebulon",), ("NASA",), ("word",), ("Ärger",)], "w string")
    assert [r[0] for r in df.select(pii._shape(df.w)).collect()] == ["name", "acronym", "word", "name"]


def test_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0

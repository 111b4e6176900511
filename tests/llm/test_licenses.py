import random

import pytest

from sparqa.llm import licenses

from .helpers import ALNUM, DOCS, documents, lower, odd_texts, prose, with_odd_columns


def brute(text):
    w = ALNUM.findall(lower(text or ""))
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = odd_texts() + [
    "Released under the MIT License.", "x under the mit license under the MIT-license", "Apache License, Version 2.0", "cc by nc cc by-nc 4.0",
    "under the mit licenses", f"{prose(1, 30000)} cc BY nc {prose(2, 10)}", "überunder the mit license é", "under the mit\x00license"]


def test_base(spark):
    docs = with_odd_columns(documents(spark, TEXTS)).repartition(2)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("text,label,errors", [
    ("released under the mit licence", "mit", 1), ("undr the MIT lisence here", "mit", 3), ("the apache licens, version 2", "apache-2", 1),
    ("Apache Lizence versiom 2.0", "apache-2", 3), ("GNU General Publik Licence", "gpl", 2), ("licenced under CC BY-NC 4.0", "cc-by-nc", 1),
    ("all right reserved", "all-rights-reserved", 1), ("é" * 50 + " under thé mit license", "mit", 1)])
def test_fuzzy(spark, text, label, errors):
    text = f"{prose(1, 20)}. {text} {prose(2, 20)}"
    r = licenses.scan_licenses(documents(spark, [text])).first()
    assert label in r.labels.split(",")
    m = next(m for m in r.matches if m.label == label)
    assert m.errors == errors and 0 < r.score <= 1
    w = ALNUM.findall(lower(text))
    assert " ".join(w[m.first_word:m.last_word + 1]) == m.text


@pytest.mark.parametrize("text", ["under the bit license", "apache license version 1", "apache license 2", "cc by nd", "gnu public", "under mit", "the mit lich"])
def test_other_licenses_are_not_taken_for_one(spark, text):
    r = licenses.scan_licenses(documents(spark, [f"{prose(1, 20)} {text} {prose(2, 20)}"])).first()
    assert r.labels == "" and r.score == 0


def every_span(text, parts):
    """{(start, end): errors} of all spans between spaces, by edit distance."""
    out = {}
    for at in (i + 1 for i, c in enumerate(text[:-1]) if c == " "):
        ends = {at: 0}
        for part, most in parts:
            after = {}
            for lo, errors in ends.items():
                near = text[lo:lo + len(part) + most]
                row = list(range(len(near) + 1))
                for i, c in enumerate(part, 1):
                    last, row = row, [i]
                    for j, d in enumerate(near, 1):
                        row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
                for j, e in enumerate(row):
                    if e <= most:
                        after[lo + j] = min(after.get(lo + j, 99), errors + e)
            ends = after
        out |= {(at, end): e for end, e in ends.items() if end > at and text[end:end + 1] == " "}
    return out


NOTES = ["under the mit license", "under the mit licence", "undr the mit lisence", "under the mit licen se", "gnu general public license version 3", "gnu general publik licence",
         "a all rights reserved", "all right reserved", "all rights reserved", "licenced under cc by nc", "apache lizence versiom 2", "apache license version 2"]


@pytest.mark.parametrize("seed", range(6))
def test_all_notices_of_a_text(seed):
    r = random.Random(seed)
    text = " " + " ".join(f"{prose(100 * seed + k, r.choice([0, 1, 3, 40]))} {r.choice(NOTES)} the" for k in range(12)) + " "
    text = text.replace("  ", " ")
    got = licenses.Searcher().find(text.encode())
    for label, parts in licenses.NOTICES:
        want, spans = every_span(text, parts), [(s, e, n) for x, s, e, n in got if x == label]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(want[s, e] == n for s, e, n in spans)
        assert all(any(s < y and x < e and n <= errors for s, e, n in spans) for (x, y), errors in want.items())


def test_a_better_notice_does_not_hide_others():
    text = f" under the mit licence {'the word ' * 50}under the mit license {prose(3, 20)} undr the mit license "
    assert [m[3] for m in licenses.Searcher().find(text.encode()) if m[0] == "mit"] == [1, 0, 1]


def test_seeds_survive_any_errors():
    for errors in (1, 2, 3):
        seeds = licenses._seeds("gnu general public license", errors)
        assert "".join(seeds) == "gnu general public license" and len(seeds) == errors + 1


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0

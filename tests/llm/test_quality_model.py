import random
import zlib

import numpy as np
import pytest

from sparqa.llm import quality_model

from .helpers import DOCS, documents, odd_texts, prose, with_odd_columns


def junk(seed):
    r = random.Random(seed)
    return " ".join(w + r.choice(["%%%", "###", "|", "&&&"]) for w in prose(seed, r.randrange(40, 200)).split())


def prose_of(seed):
    return prose(seed, random.Random(seed).randrange(40, 200))


@pytest.fixture(scope="module")
def corpus():
    texts, labels = [], []
    for s in range(400):
        bad = s % 4 == 0
        texts.append(junk(s) if bad else prose(s, random.Random(s).randrange(40, 200)))
        labels.append((s, 0 if bad else 1))
    return texts, labels


def test_held_out_accuracy(spark, corpus):
    texts, labels = corpus
    docs = with_odd_columns(documents(spark, texts + odd_texts()))
    odd_labels = [(None, 1), (5, None), (9_999, 0), (401, 1), (401, 0)]
    table = spark.createDataFrame(labels + odd_labels + labels[:3], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.classify(docs, table).collect()}
    assert len(got) == len(texts) + len(odd_texts())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, _ in labels if got[i].held_out]
    assert len(held) > 50 and sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.95


def test_long_texts_count_whole(corpus):
    texts, labels = corpus
    model = quality_model.fit([(t.encode(), y) for t, (_, y) in zip(texts, labels, strict=True)])
    tools = model.compressors()

    def difference(text):
        return model.features(text.encode(), tools)[0]

    for make, sign in ((junk, -1), (prose_of, 1)):
        parts = [make(s) for s in range(10_000, 10_300)]
        mean = sum(map(difference, parts)) / len(parts)
        long = difference(" ".join(parts))
        assert mean * sign > 0 and long * sign > 0.6 * mean * sign
        assert (model.score(np.array([model.features(" ".join(parts).encode(), tools)]))[0] >= 0.5) == (sign > 0)
    # what stands at the end weighs as much as what stands at the beginning
    good, bad = (" ".join(make(s) for s in range(20_000, 20_100)) for make in (prose_of, junk))
    first, last = difference(good + " " + bad), difference(bad + " " + good)
    assert abs(first - last) < 0.1 * (difference(good) - difference(bad))


def test_pieces():
    for n in (0, 1, 1023, 1024, 1025, 5_000):
        cut = quality_model.pieces(bytes(i % 251 for i in range(n)))
        assert b"".join(cut) == bytes(i % 251 for i in range(n))
        assert max(map(len, cut)) <= quality_model.PIECE and max(map(len, cut)) - min(map(len, cut)) <= 1


def test_few_labels(spark, corpus):
    docs = documents(spark, corpus[0][:20])
    for labels in ([], [(1, 1)], [(1, 1), (0, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        got = quality_model.classify(docs, table).collect()
        assert len(got) == 20 and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(spark.createDataFrame([], DOCS), table).count() == 0


def test_sample_is_bounded(spark, corpus):
    texts, labels = corpus
    rows = quality_model.sample(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"), rows=30)
    assert [y for _, y in rows].count(0) <= 30 and [y for _, y in rows].count(1) == 30
    train = {t for (i, _), t in zip(labels, texts, strict=True) if zlib.crc32(str(i).encode()) % 5}
    assert all(t.decode() in train for t, _ in rows)

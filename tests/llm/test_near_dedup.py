import random

import pytest
from sparqa.llm import near_dedup, shared

from .helpers import DOCS, SPACE, documents, edited, lower, odd_texts, prose, with_odd_columns


def shingle_set(text, k):
    w = SPACE.findall(lower(text or ""))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False))


def brute(rows, k):
    """Components over all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y in range(x):
            t = sets[y][1]
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                parent[find(x)] = find(y)
    low = {}
    for x, (i, _) in enumerate(sets):
        low[find(x)] = min(i, low.get(find(x), i))
    return {i: (len(s), low[find(x)]) for x, (i, s) in enumerate(sets)}


def corpus():
    texts = odd_texts()
    for seed in range(12):
        base = prose(seed, 120)
        # a chain and a cloud around one text, near and beyond the threshold
        texts += [base] + [edited(base, 1000 * seed + j, 0.01 * j) for j in range(12)]
        step = base
        for j in range(5):
            step = edited(step, 7000 + 10 * seed + j, 0.04)
            texts.append(step)
    return texts + [prose(s, 60) for s in range(500, 560)]


@pytest.mark.parametrize(("k", "small", "distance"), [(2, 64, near_dedup.MAX_DISTANCE), (5, 2, near_dedup.MAX_DISTANCE), (2, 2, None)])
def test_same_components_as_all_pairs(spark, monkeypatch, k, small, distance):
    """Also with the prefix join for all buckets and without the signature filter."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    docs = with_odd_columns(documents(spark, corpus())).repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(sorted(rows), k)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, k, 80, distance).collect()}
    assert len(got) == len(want)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    # one of each group stays, and everything without words
    kept = near_dedup.keep_first(docs, k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in want.values()})


def test_dense_group_stays_whole(spark):
    """Hundreds of different near copies under the same keys: one component,
    and pairs confirmed stay far below all pairs."""
    base = prose(1, 200)
    texts = [edited(base, j, 0.02) for j in range(300)] + [prose(s, 200) for s in range(2000, 2020)]
    got = near_dedup.near_duplicates(documents(spark, texts), 2).collect()
    assert brute(list(enumerate(texts)), 2) == {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_group_below_the_threshold(spark, monkeypatch):
    """A crowd whose members meet under the same keys but are hardly ever linked."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    base = prose(11, 150)
    texts = [edited(base, j, 0.07) for j in range(160)]
    got = near_dedup.near_duplicates(documents(spark, texts), 2).collect()
    want = brute(list(enumerate(texts)), 2)
    assert len({c for _, c in want.values()}) > 60
    assert want == {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("percent", [60, 80])
def test_prefix_join_finds_every_linked_pair(spark, percent):
    r = random.Random(percent)
    sets = []
    for _ in range(12):
        core = r.sample(range(3000), 60)
        sets += [r.sample(core, r.randrange(40, 60)) + [r.randrange(10_000, 10**9) for _ in range(r.randrange(20))] for _ in range(15)]
    sets = [sorted(set(x)) for x in sets] + [[1], [1, 2], [2]]
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(sets)], "cid long, component long, members array<long>")
    got = {(x.a, x.b) for x in near_dedup._prefix_pairs(df, percent).collect()}
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(set(x) & set(sets[j]))
            if 100 * both >= percent * (len(x) + len(sets[j]) - both):
                assert (j, i) in got
    assert len(got) < len(sets) ** 2 / 8


def test_null_and_repeated_ids(spark):
    t = prose(3, 80)
    rows = [(None, t), (None, t), (5, t), (5, t), (4, prose(4, 80)), (None, None), (None, prose(6, 80)), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 5).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.n_shingles and r.doc_id) == [(4, 4), (5, 5), (5, 5)]
    kept = near_dedup.keep_first(docs, 5).collect()
    assert len([r for r in kept if r.text == t]) == 1 and len(kept) == 5


def test_an_id_in_several_groups(spark):
    """Rows are led by (doc_id, text): a repeated doc_id neither keeps a near
    duplicate nor links its texts."""
    a, b = prose(40, 100), prose(41, 100)
    near = b.replace(b.split()[50], "other")
    rows = [(5, a), (5, b), (3, near), (9, a), (None, a), (None, prose(42, 90)), (None, prose(42, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect() if r.doc_id) == [
        (3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)], got
    kept = sorted([(r.doc_id, r.text) for r in near_dedup.keep_first(docs, 2).collect()], key=str)
    assert kept == sorted([(3, near), (5, a), (None, prose(42, 90))], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert near_dedup.near_duplicates(docs, 2).count() == 0
    assert near_dedup.keep_first(docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_edges(spark, seed):
    """Hubs, long chains and scattered edges over many tasks."""
    r = random.Random(seed)
    edges = [(0, 10_000 + i) for i in range(800)] + [(20_000 + i, 20_001 + i) for i in range(700)] + [(r.randrange(3000), r.randrange(3000)) for _ in range(1400)]
    r.shuffle(edges)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {x.node: x.component for x in got} == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 300), (7, 7)]
    got = shared.components(spark.createDataFrame(chain, "a long, b long"))
    want = {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert {r.node: r.component for r in got.collect()} == want


@pytest.mark.parametrize("packing,values", [(near_dedup.INDEXED, near_dedup.VALUES), (near_dedup.SKETCHED, near_dedup.FINE)])
def test_signature_distance_counts_values(spark, packing, values):
    bits, many = packing
    longs, top = near_dedup._longs(values, packing), (1 << bits) - 1
    x = [0] * longs
    y = [0] * (longs - 2) + [top, sum(v << (bits + 1) * j for j, v in enumerate([1, 5, 0, top][:many]))]
    df = spark.createDataFrame([(x, y), (x, x), (y, x)], "x array<long>, y array<long>")
    got = [r.d for r in df.select(near_dedup._differences("x", "y", packing, values).alias("d")).collect()]
    assert got == [4, 0, 4]

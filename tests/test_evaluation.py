"""G: the shipped per-question values reproduce the shipped summary and the
derived report numbers."""

import pytest

from sparqa.operators import evaluation as G

# (question_id, source_used, expected_source, similarity_score, context_retrieved, is_grounded, latency_ms)
SHIPPED = [
    (1, "uncertain", "dataset", 0.0, False, False, 3191.68),
    (2, "uncertain", "dataset", 0.07072042742676223, True, False, 4480.51),
    (3, "dataset", "dataset", 0.5738096275319133, True, True, 10.28),
    (4, "dataset", "dataset", 0.5527962719240656, True, True, 5.87),
    (5, "llm", "dataset", 0.25674977726059806, True, False, 5314.17),
    (6, "dataset", "dataset", 0.8562093448768936, True, True, 7.8),
    (7, "uncertain", "llm", 0.0, False, False, 363.8),
    (8, "dataset", "dataset", 0.58194294272876, True, True, 14.2),
    (9, "uncertain", "dataset", 0.055150803199830345, True, False, 3706.84),
    (10, "uncertain", "dataset", 0.03758540116965041, True, False, 4284.16),
    (11, "uncertain", "llm", 0.017845651443401552, True, False, 1193.21),
    (12, "uncertain", "dataset", 0.18425461785345448, True, False, 4172.71),
    (13, "uncertain", "dataset", 0.10372903481516524, True, False, 1029.24),
    (14, "uncertain", "dataset", 0.05654619794344326, True, False, 2637.32),
    (15, "llm", "llm", 0.259671943403018, True, False, 5132.21),
]


@pytest.fixture(scope="module")
def res(spark):
    df = spark.createDataFrame(SHIPPED, "question_id long, source_used string, expected_source string, "
                                        "similarity_score double, context_retrieved boolean, "
                                        "is_grounded boolean, latency_ms double")
    from pyspark.sql import functions as F
    return df.withColumn("source_match", F.col("expected_source").isNull() |
                         (F.col("source_used") == F.col("expected_source"))) \
        .withColumn("topic", F.lit("t"))


def test_summary(res):
    s = G.evaluation_summary(res).first()
    assert (s.total_questions, s.successful_responses) == (15, 15)
    assert s.context_retrieval_rate == pytest.approx(0.8666666666666667, abs=1e-6)
    assert s.mean_similarity == pytest.approx(0.24046746943846375, abs=1e-6)
    assert s.mean_latency_ms == pytest.approx(2369.6, abs=1e-6)
    assert s.grounding_rate == pytest.approx(0.26666666666666666, abs=1e-6)


def test_derived(res):
    lat = G.latency_stats(res).first()
    assert (lat.median, lat.min, lat.max) == (2637.32, 5.87, 5314.17)
    assert lat.std == pytest.approx(2064.91, abs=0.01)
    sim = G.similarity_stats(res).first()
    assert sim.n == 13
    assert sim.mean == pytest.approx(0.27746, abs=1e-5)
    assert sim.median == pytest.approx(0.18425, abs=1e-5)
    assert sim.std == pytest.approx(0.27338, abs=1e-5)
    by = {r.source_used: r for r in G.latency_by_source(res).collect()}
    assert by["dataset"].mean == pytest.approx(9.5375, abs=1e-4) and by["dataset"].median == pytest.approx(9.04)
    assert by["llm"].mean == pytest.approx(5223.19, abs=1e-2)
    assert by["uncertain"].median == pytest.approx(3191.68)
    acc = G.source_accuracy(res).first()
    assert (acc.matches, acc.expected) == (5, 15)
    hit = G.dataset_hit_accuracy(res).first()
    assert (hit.hits, hit.expected) == (4, 12)


def test_exact_median_even_odd(spark):
    df = spark.createDataFrame([(k, float(v)) for k, vs in {"a": [1, 2, 3, 4], "b": [5, 5, 5], "c": [7]}.items()
                                for v in vs], "k string, v double")
    got = {r.k: r.median for r in G.exact_median(df, "v", ["k"]).collect()}
    assert got == {"a": 2.5, "b": 5.0, "c": 7.0}

"""One question per routing step of the cascade."""

import pytest
from pyspark.sql import functions as F

from sparqa.config import DEFAULT
from sparqa.operators import answering as A
from sparqa.operators.index import fit_index
from sparqa.plans.corpus import DOC_KEY, Corpus

UNC = DEFAULT.uncertain_response


def corpus(spark, texts, name):
    ch = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)],
                               "doc_id long, chunk_idx long, chunk_text string")
    idx = fit_index(ch, DOC_KEY, materialize=True)
    answers = ch.select("doc_id", "chunk_idx", F.col("chunk_text").alias("text"))
    return Corpus(name, ch, DOC_KEY, idx, answers, DOC_KEY)


@pytest.fixture(scope="module")
def scenario(spark):
    main = corpus(spark, [
        "python lists store ordered items mutable sequences",
        "dictionaries map keys to values with hashing for fast lookups",
        "generators yield values lazily through the iteration protocol",
        "decorators wrap functions adding behaviour using closures",
        "tuples immutable sequences packing unpacking",
    ], "main")
    up = corpus(spark, [
        "spark shuffles partitions across executors over network",
        "parquet files columnar storage compression encoding",
    ], "up")
    qs = spark.createDataFrame([
        (1, "spark shuffles partitions across executors over network"),  # uploaded
        (2, "python lists store ordered items mutable sequences"),       # curated
        (3, "what are generators"),        # strong context, relevant answer
        (4, "what are decorators"),        # strong context, irrelevant answer
        (5, "hashing closures lazily"),    # weak context
        (6, "closures zebra quantum physics rocket"),  # empty generation
        (7, "hashing zebra quantum physics"),          # uncertain text leaked
        (8, "zebra quantum"),              # no context
    ], "query_id long, question string")
    gen = spark.createDataFrame([
        (1, "x"), (2, "x"),
        (3, "Generators yield values lazily through the iteration protocol."),
        (4, "Bananas are yellow tropical fruit grown in warm places."),
        (5, "Rockets fly to space quickly."), (6, ""), (7, UNC),
        (8, "Zebras are striped animals."),
    ], "query_id long, raw string")
    return main, up, qs, gen


def test_route_answers(spark, scenario):
    main, up, qs, gen = scenario
    out = {r.query_id: r for r in A.route_answers(qs, main, up, gen, DEFAULT, use_uploaded=True).collect()}
    assert (out[1].source, out[1].dataset_source, out[1].is_grounded, out[1].similarity_score) == \
        ("uploaded", "uploaded_files", True, 1.0)
    assert (out[2].source, out[2].dataset_source, out[2].is_grounded) == ("dataset", "main_dataset", True)
    assert (out[3].source, out[3].dataset_source, out[3].is_grounded) == ("llm", "llm_fallback", True)
    assert out[3].similarity_score >= DEFAULT.relevance_threshold
    assert (out[4].source, out[4].dataset_source, out[4].is_grounded, out[4].response) == \
        ("uncertain", None, False, UNC)
    assert (out[5].source, out[5].dataset_source, out[5].is_grounded) == ("llm", "llm_fallback", False)
    assert 0.2 <= out[5].similarity_score <= DEFAULT.strict_context_score
    assert (out[6].source, out[6].dataset_source, out[6].similarity_score) == ("uncertain", "none", 0.0)
    assert (out[7].source, out[7].dataset_source) == ("uncertain", "none")
    assert (out[8].source, out[8].dataset_source, out[8].similarity_score, out[8].response) == \
        ("llm", "llm_fallback", 0.0, "Zebras are striped animals.")


def test_no_generator(spark, scenario):
    main, up, qs, _ = scenario
    out = {r.query_id: r for r in A.route_answers(qs, main, up, None, DEFAULT, use_uploaded=True).collect()}
    assert out[1].source == "uploaded" and out[2].source == "dataset"
    for i in range(3, 9):
        assert (out[i].source, out[i].dataset_source, out[i].similarity_score) == ("uncertain", "none", 0.0)


def test_without_uploads(spark, scenario):
    main, up, qs, gen = scenario
    out = {r.query_id: r for r in A.route_answers(qs, main, up, gen, DEFAULT, use_uploaded=False).collect()}
    assert out[1].source != "uploaded"


def test_generator_hook_and_ask(spark, scenario):
    main, up, qs, _ = scenario
    calls = lambda s: s.str.upper()  # noqa: E731 - a batch generator
    asked = qs.unionByName(spark.createDataFrame([(9, "   ")], "query_id long, question string"))
    out = {r.query_id: r for r in A.answer_questions(asked, main, up, calls, DEFAULT, True).collect()}
    assert out[9].response == "Please provide a question." and out[9].source == "uncertain"
    assert out[9].is_grounded is None
    # the prompt of a question without context is the short form, upper-cased
    assert out[8].source == "llm" and out[8].response.startswith("ANSWER THIS PYTHON")


def test_gates(spark):
    gen = spark.createDataFrame([(1, "short"), (2, ""), (3, "  " + UNC + " ok"), (4, "A long enough answer.")],
                                "query_id long, raw string")
    out = {r.query_id: r for r in A.gate_generated(A.postprocess_generated(gen)).collect()}
    assert out[1].gate_reason == "empty"   # shorter than 10 after cleaning
    assert out[2].gate_reason == "empty"
    assert out[3].gate_reason == "leak"
    assert out[4].gate_reason is None and out[4].answer == "A long enough answer."


def test_prompt_modes_and_empty_relevance(spark):
    qs = spark.createDataFrame([(1, "What is a list?")], "query_id long, question string")
    ctx = spark.createDataFrame([], "query_id long, pos long, text string, score double")
    assert A.assemble_prompts(qs, ctx, use_llm=False).first().prompt == "What is a list?"
    short = A.assemble_prompts(qs, ctx).first().prompt
    assert short == DEFAULT.prompt_prefix + "\n\nWhat is a list?\n\nAnswer:"
    ctx2 = spark.createDataFrame([(1, 1, '["Lists are ordered.", ""]', 0.4), (1, 2, "  Lists   grow. ", 0.3)],
                                 "query_id long, pos long, text string, score double")
    full = A.assemble_prompts(qs, ctx2).first().prompt
    assert "Relevant information:\nLists are ordered.\n\nRelevant information:\nLists grow." in full
    ans = spark.createDataFrame([(1, "Lists are ordered.")], "query_id long, answer string")
    rel = A.check_answer_relevance(ans, ctx).first()
    assert (rel.relevance, rel.is_relevant) == (0.0, False)


def test_rank_chunks(spark):
    from sparqa.operators.retrieval import rank_chunks

    hits = spark.createDataFrame([(1, 0, 0.3), (1, 1, 0.8), (1, 2, 0.5)], "query_id long, doc_id long, score double")
    assert [r.score for r in rank_chunks(hits, ["doc_id"]).collect()] == [0.8, 0.5, 0.3]


def counting_generator(path):
    def generate(prompts):
        import os
        import uuid
        for p in prompts:
            with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
                f.write(p)
        return prompts.str.len().astype(str) + " characters long, an answer about zebras"
    return generate


def test_generator_sees_each_prompt_once(spark, scenario, tmp_path):
    main, up, qs, _ = scenario
    out = A.route_answers(qs, main, up, counting_generator(str(tmp_path)), DEFAULT, use_uploaded=True)
    answered = {r.query_id: r.source for r in out.collect()}
    assert len(answered) == 8 and answered[8] == "llm"
    assert len(list(tmp_path.iterdir())) == sum(s in ("llm", "uncertain") for s in answered.values())


def test_question_without_generated_row_is_uncertain(spark, scenario):
    main, up, qs, gen = scenario
    out = {r.query_id: r for r in A.route_answers(qs, main, up, gen.where("query_id not in (3, 8)"), DEFAULT, use_uploaded=True).collect()}
    for i in (3, 8):
        assert (out[i].source, out[i].response, out[i].dataset_source, out[i].similarity_score) == ("uncertain", UNC, "none", 0.0)


def test_without_any_index(spark, scenario):
    _, _, qs, gen = scenario
    empty = Corpus("main", qs, DOC_KEY, None)
    for main in (None, empty):
        assert {r.source for r in A.route_answers(qs, main, None, None, DEFAULT).collect()} == {"uncertain"}
        out = {r.query_id: r.source for r in A.route_answers(qs, main, empty, gen, DEFAULT, use_uploaded=True).collect()}
        assert out[8] == "llm" and out[6] == "uncertain"


def test_null_and_blank_questions_get_the_fixed_reply(spark, scenario):
    main, up, qs, gen = scenario
    asked = qs.where("query_id < 3").unionByName(spark.createDataFrame([(20, None), (21, " \t")], qs.schema))
    out = {r.query_id: r for r in A.answer_questions(asked, main, up, gen, DEFAULT, use_uploaded=True).collect()}
    assert set(out) == {1, 2, 20, 21}
    assert all((out[i].question, out[i].source, out[i].is_grounded) == ("", "uncertain", None) for i in (20, 21))


def test_factory_once_per_worker_and_failing_prompts(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "query_id long, prompt string").coalesce(1)

    def factory():
        import os
        import uuid
        made = f"{os.getpid()}-{uuid.uuid4().hex}"

        def generate(batch):
            if (batch == "p7").any():
                raise RuntimeError("cannot answer p7")
            return batch + " " + made
        return generate

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = {r.query_id: r for r in A.generate_answers(prompts, factory=factory, with_errors=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[7].raw == "" and "cannot answer p7" in out[7].error
    assert len(out) == 40 and all(r.error is None and r.raw.startswith(f"p{i} ") for i, r in out.items() if i != 7)
    assert len({r.raw.split()[1] for i, r in out.items() if i != 7}) == 1


def test_select_source(spark, scenario):
    from sparqa.operators.retrieval import select_source

    main, up, qs, _ = scenario
    sources = {"main": main, "uploaded": up, "none": None, "empty": Corpus("e", qs, DOC_KEY, None)}
    assert {r.query_id for r in select_source(sources, "main", qs).collect()} >= {2}
    assert {r.query_id for r in select_source(sources, "uploaded", qs).collect()} == {1}
    for name in ("none", "empty", "elsewhere"):
        assert select_source(sources, name, qs).columns == ["query_id", "rank", "score", "text"] and select_source(sources, name, qs).isEmpty()

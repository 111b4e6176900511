"""Stored generation: calls are counted; vocabularies as tokenizers of C6."""

import os
import tempfile
from collections import Counter

import pytest

from sparqa.functions.tokenizers import vocabulary_tokenizer
from sparqa.operators import answering as A
from sparqa.operators.chunking import pack_token_blocks

VOCABULARIES = "/opt/tokenizers"


def counting(log, broken=()):
    def generator(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        if any(p in broken for p in prompts):
            raise ValueError("no answer")
        return prompts.str.upper()
    return generator


def calls(log):
    with open(log) as f:
        return Counter(f.read().splitlines())


def test_each_prompt_is_generated_once(spark):
    root = tempfile.mkdtemp(prefix="sparqa-test-")
    log, store = f"{root}/log", f"{root}/store"
    prompts = spark.createDataFrame([(i, f"prompt {i % 7}") for i in range(40)] + [(99, None)], "query_id long, prompt string").repartition(3)
    first = A.generate_stored(prompts.where("query_id % 7 < 3"), store, counting(log), batch_prompts=2)
    assert {(r.query_id, r.raw) for r in first.where("query_id < 40").collect()} == {(i, f"PROMPT {i % 7}") for i in range(40) if i % 7 < 3}
    before = calls(log)
    assert all(before[f"prompt {i}"] == 1 for i in range(3)) and "prompt 3" not in before
    every = A.generate_stored(prompts, store, counting(log), batch_prompts=3)
    assert {(r.query_id, r.raw) for r in every.where("query_id < 40").collect()} == {(i, f"PROMPT {i % 7}") for i in range(40)}
    every.collect()  # reading the result again calls nothing
    assert all(calls(log)[f"prompt {i}"] == 1 for i in range(7))


def test_failures_are_tried_again(spark):
    root = tempfile.mkdtemp(prefix="sparqa-test-")
    log, store = f"{root}/log", f"{root}/store"
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(5)], "query_id long, prompt string").repartition(1)
    got = {r.query_id: r for r in A.generate_stored(prompts, store, counting(log, {"prompt 3"})).collect()}
    assert got[3].raw == "" and "no answer" in got[3].error and got[2].raw == "PROMPT 2" and got[2].error is None
    os.remove(log)
    got = {r.query_id: r for r in A.generate_stored(prompts, store, counting(log)).collect()}
    assert got[3].raw == "PROMPT 3" and got[3].error is None
    assert calls(log) == {"prompt 3": 1}


def test_a_broken_job_keeps_what_is_stored(spark):
    """Workers that die in a later batch cost no stored prompt."""
    root = tempfile.mkdtemp(prefix="sparqa-test-")
    log, store = f"{root}/log", f"{root}/store"
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(30)], "query_id long, prompt string")

    def dying(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        with open(log) as f:
            asked = len(f.readlines())
        if asked > 15:
            raise SystemExit  # not an answer that failed: the worker ends
        return prompts.str.upper()

    with pytest.raises(Exception):  # noqa: B017
        A.generate_stored(prompts, store, dying, batch_prompts=5).collect()
    done = {r.raw.lower() for r in spark.read.parquet(store).collect()}
    assert 0 < len(done) < 30
    os.remove(log)
    got = A.generate_stored(prompts, store, counting(log)).collect()
    assert {r.raw for r in got} == {f"PROMPT {i}" for i in range(30)}
    assert not done & set(calls(log))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_blocks_of_vocabulary_tokens(spark, name):
    if not os.path.exists(f"{VOCABULARIES}/{name}"):
        pytest.skip("vocabulary not present")
    texts = [f"Text {i} über naïve 日本 tokens, don't split <|endoftext|>\n\n  twice!  " * (i % 4) for i in range(40)] + [None, "", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    blocks = pack_token_blocks(docs, 16, tokenizer=vocabulary_tokenizer(f"{VOCABULARIES}/{name}")).collect()
    path = f"{VOCABULARIES}/{name}"
    if name.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path.replace(".tiktoken", ".json"))  # the same vocabulary
        t.encode_special_tokens = True
        encode = lambda x: t.encode(x, add_special_tokens=False).ids
    stream = [i for x in texts for i in encode(x or "")]
    want = {b: stream[16 * b: 16 * b + 16] for b in range(len(stream) // 16)}
    assert {r.block_id: r.tokens for r in blocks} == want and len(want) > 50


def test_unknown_vocabulary():
    with pytest.raises(ValueError):
        vocabulary_tokenizer("words.txt")


def test_stand_in_generator_runs_without_this_package(tmp_path):
    """Python workers of a cluster have pyspark and pandas, not this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from sparqa.plans.registry import extractive_generator

    (tmp_path / "g").write_bytes(cloudpickle.dumps(extractive_generator))
    code = "import pickle, pandas; print(list(pickle.load(open('g', 'rb'))(pandas.Series(['a\\n\\nb\\n\\nc']))))"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60).stdout == "['b']\n"

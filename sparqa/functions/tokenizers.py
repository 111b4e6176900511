"""Tokenizers from vocabulary files of public tokenizers.

A vocabulary is read once on the driver (its path is the caller's), travels
with the function and is loaded once in each Python worker; texts are encoded
in Arrow batches.  Nothing is trained here.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Python workers need the tokenizer library, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: how byte-level BPE vocabularies given as ranks cut a text before merging (fixed value)
BYTE_BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_LOADED: dict = {}


def _loaded(kind: str, data: bytes):
    """The batch encoder of a vocabulary, kept per worker process."""
    key = kind, hashlib.md5(data).digest()
    if key not in _LOADED:
        if kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(data.decode())
            t.encode_special_tokens = True  # their strings in a text are ordinary text
            _LOADED[key] = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        elif kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            e = tiktoken.Encoding("vocabulary", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[key] = lambda texts: [e.encode_ordinary(t) for t in texts]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=data)
            _LOADED[key] = lambda texts: p.encode(texts, num_threads=1)
    return _LOADED[key]


#: UTF-8 bytes of texts that are encoded at once (a longer text goes alone)
SLICE_BYTES = 1 << 20


def _slices(sizes: pa.Array):
    """(first, number) of consecutive texts of up to SLICE_BYTES.  An encoded text is
    many times its size until its ids are taken, so the memory of a batch of rows must
    not follow from their number."""
    lo = held = 0
    for i, size in enumerate(sizes.to_pylist()):
        if i > lo and held + (size or 0) > SLICE_BYTES:
            yield lo, i - lo
            lo, held = i, 0
        held += size or 0
    if len(sizes) > lo:
        yield lo, len(sizes) - lo


def vocabulary_tokenizer(path: str):
    """A tokenizer (text column -> ``array<int>`` of token ids) of a vocabulary
    file: ``.json``, ``.tiktoken`` ranks or a ``.model`` of pieces.  A null
    text has no tokens."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "tiktoken", "model"):
        raise ValueError(f"no tokenizer for .{kind} files")
    with open(path, "rb") as f:
        data = f.read()

    def encode(texts: pa.Array) -> pa.Array:
        encoder, made = _loaded(kind, data), []
        for lo, n in _slices(pc.binary_length(texts)):
            ids = encoder([t or "" for t in texts.slice(lo, n).to_pylist()])
            made.append(pa.array(ids, pa.list_(pa.int32())))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))

    def tokenizer(text: Column) -> Column:
        return F.arrow_udf(encode, "array<int>")(text)

    return tokenizer

"""Compression quality classifier.

Two zstandard dictionaries are built from good and from bad labelled texts.  A
text is cut into pieces, each compressed on its own, so that the dictionaries
count alike at every place of it.  Its score is calibrated from how much smaller
the pieces compress with one than with the other, relative to their plain size:
logistic regression on the normalised compressed-size difference and size,
fitted on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import column_bytes

#: labelled rows a class that the model is fitted on at most (a sample by hash), and bytes of them
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 24 << 20
#: one in so many of these rows calibrates, the others make the dictionaries
CALIBRATION = 3
DICT_BYTES, LEVEL = 1 << 16, 3
#: bytes of the pieces that dictionaries are trained on and texts are compressed in
PIECE = 1024
THRESHOLD = 0.3


def held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 5 is 0; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def pieces(raw: bytes) -> list[bytes]:
    """``raw`` cut into the fewest equal pieces (within a byte) of at most PIECE
    bytes: no short last one, whose headers would weigh more."""
    n = max(1, -(-len(raw) // PIECE))
    return [raw[i * len(raw) // n: (i + 1) * len(raw) // n] for i in range(n)]


class Model:
    def __init__(self, good: bytes, bad: bytes, weights, center, scale):
        self.good, self.bad = good, bad
        self.weights, self.center, self.scale = map(np.asarray, (weights, center, scale))

    def compressors(self):
        def one(raw):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        return one(self.good), one(self.bad), plain

    def features(self, raw: bytes, compressors) -> tuple:
        """Normalised size difference (above 0: closer to the good texts), its
        square, and the logarithm of the plain compression ratio, of the summed
        sizes of the text's pieces."""
        if not raw:
            return 0.0, 0.0, 0.0
        cut = pieces(raw)
        good, bad, plain = (sum(len(c.compress(x)) for x in cut) for c in compressors)
        d = (bad - good) / max(plain, 1)
        return d, d * d, float(np.log(plain / len(raw)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + z @ self.weights[1:], -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled, not held out texts a class, by a hash of
    doc_id.  Doc_ids labelled in two ways, and null ones, are left out."""
    ids = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    ids = ids.where("y = z and doc_id is not null").where(~held_out())
    order = F.xxhash64(F.lit(17), F.col("doc_id"))
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows).select("doc_id", "y")
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * rows ids
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("length(text) > 0")
    texts = texts.withColumn("order", order).withColumn("bytes", F.octet_length("text"))
    texts = texts.dropDuplicates(["doc_id"])
    picked, used = [], {0: 0, 1: 0}
    for r in texts.orderBy("order").toLocalIterator():
        if used[r["y"]] + r["bytes"] <= SAMPLE_BYTES:
            used[r["y"]] += r["bytes"]
            picked.append((r["text"].encode("utf-8", "replace"), int(r["y"])))
    return picked


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Dictionaries and calibration from labelled texts."""
    made = [r for i, r in enumerate(rows) if i % CALIBRATION]
    held = [r for i, r in enumerate(rows) if i % CALIBRATION == 0]

    def dictionary(y):
        texts = [t for t, label in made if label == y]
        # the trainer wants many short samples: whole texts cut into pieces
        cut = [x for t in texts for x in pieces(t)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, cut, k=64, d=6).as_bytes()
        except zstandard.ZstdError:  # too few samples for a trained one
            return b"".join(cut)[:DICT_BYTES] or b" " * 8

    model = Model(dictionary(1), dictionary(0), np.zeros(4), np.zeros(3), np.ones(3))
    tools = model.compressors()
    use = held if len({y for _, y in held}) == 2 else rows
    x = np.array([model.features(t, tools) for t, _ in use]).reshape(-1, 3)
    y = np.array([label for _, label in use], float)
    if len({*y}) < 2:  # nothing to tell apart: the only label, softened
        rate = (y.sum() + 1) / (len(y) + 2)
        model.weights = np.array([np.log(rate / (1 - rate)), 0, 0, 0])
        return model
    model.center, model.scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale])
    w = np.zeros(a.shape[1])
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-6)[:, None]) + 0.5 * np.eye(len(w)), a.T @ (y - p) - 0.5 * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    model.weights = w
    return model


def _score(model: Model):
    def run(batches):
        tools = model.compressors()
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            x = np.array([model.features(data[off[i]: off[i + 1]].tobytes(), tools) for i in range(batch.num_rows)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(x[:, 0]), pa.array(model.score(x))], ["doc_id", "held_out", "difference", "score"])
    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id: long, text): doc_id, held_out,
    difference (normalised compressed-size difference), score (0 to 1, higher:
    quality 1 likelier), predicted.

    Fitted on a bounded sample (SAMPLE_ROWS rows and SAMPLE_BYTES bytes a
    class) of the labelled rows that are not held out.  Null and empty texts
    have difference 0 and the score that belongs to it; every piece of a text
    is compressed, whatever its length; repeated rows are scored alike; other
    columns are not read.  Without any label every score is 0.5 (or the
    softened rate of the only label there is); an empty table gives an empty
    result."""
    model = fit(sample(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, difference double, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))

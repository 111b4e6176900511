"""TF-IDF index as two plain tables.

``vocab(term, df, idf)`` holds at most ``max_features`` rows;
``postings(<chunk key>, term, weight)`` holds the L2-normalised TF-IDF weight
of every (chunk, vocabulary term) pair.  Vectoriser semantics: lower-case,
tokens are runs of two or more word characters, English stop words removed,
vocabulary = the ``max_features`` terms with the largest corpus count (ties:
term ascending), smooth idf ``ln((1+N)/(1+df))+1`` with N = all chunks
(empty ones included), raw term counts, L2 norm per chunk.

Plan shape of ``fit_index``: the chunk rows are hash-partitioned once on
their key and tokenised once; the term counts are written with one row a chunk
(``count_terms``), and the norms and weights are computed chunk by chunk from
that table, without another exchange or a sort (``weigh_counts``).  A built index
is stored with one row a chunk as well (``weigh_vectors``), ``postings`` being a
view of it.  The only
other shuffle is the per-term statistics, which is partially aggregated before
it moves, so a very frequent term costs one row per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.stopwords import ENGLISH_STOP_WORDS
from ..functions.text import col_, normalize_query

# Word tokens: two or more letters, digits or underscores (a Unicode \w run).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens_expr(text):
    """``array<string>`` of lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(col_(text)), F.lit(TOKEN_PATTERN), 0)


def stop_words_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in ENGLISH_STOP_WORDS], "term string")


def remove_stop_words(tokens: DataFrame, term_col: str = "term") -> DataFrame:
    """Left anti join with the (fixed-size, broadcast) stop list."""
    stop = stop_words_df(tokens.sparkSession).withColumnRenamed("term", term_col)
    return tokens.join(F.broadcast(stop), term_col, "left_anti")


def term_frequency(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """``(key..., term, tf)``."""
    # explode_outer: no inferred ``size(...) > 0`` filter that would run the
    # tokenizer a second time; rows of empty arrays come out with a null term,
    # dropped.
    exploded = df.select(*key_cols, F.explode_outer(tokens_expr(text_col)).alias("term"))
    kept = remove_stop_words(exploded.where(F.col("term").isNotNull()))
    return kept.groupBy(*key_cols, "term").agg(F.count(F.lit(1)).alias("tf"))


@dataclass
class TfidfIndex:
    vocab: DataFrame       # term, df, idf, n_docs
    postings: DataFrame    # key..., term, weight
    key_cols: list
    folders: int = 0       # folders of a saved index, by hash of the term (column ``folder``)
    counts: dict | None = None  # of a saved index: chunks, postings, terms
    vectors: DataFrame | None = None  # of a built index, one row a chunk: key..., __v array<struct<__n, weight>>
    words: list | None = None         # the term of every number __n

    def materialize(self) -> "TfidfIndex":
        from ..session import materialize

        return TfidfIndex(materialize(self.vocab), materialize(self.postings), self.key_cols)

    def folder_of(self, term: str):
        """The folder of a term in a saved index (0 without folders)."""
        return term_folder(term, max(self.folders, 1))

    def holding(self, terms: list, folders: list) -> DataFrame:
        """The postings of ``terms``; ``folders`` are theirs."""
        if self.vectors is not None:
            asked = set(terms)
            return vector_rows(self.vectors, self.words, self.key_cols, [n for n, w in enumerate(self.words) if w in asked])
        rows = self.postings
        if self.folders:
            rows = rows.where(F.col("folder").isin(sorted(folders)))
        return rows.where(F.col("term").isin(sorted(terms))) if terms else rows.limit(0)


def term_folder(term: str, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


# chunks per bucket of the index tables
CHUNKS_PER_BUCKET = 200_000


def fit_index(chunks: DataFrame, key_cols: list[str], text_col: str = "chunk_text",
              max_features: int = DEFAULT.max_features, materialize: bool = False,
              buckets: int | None = None) -> TfidfIndex:
    """D7 ``fit_index``: D1-D6 composed.  The chunk texts are shuffled and
    tokenised once; the term counts and the vocabulary are written, the counts
    as a table bucketed by the chunk key (``buckets``: by default as many as
    CHUNKS_PER_BUCKET asks for, the shuffle partitions at least), and the
    weights are computed from them.  With ``materialize`` the weights are
    written as well, with one row a chunk (``materialize`` reads the chunk
    count, so the chunks should be a stored table)."""
    from ..session import bucketed_table, materialize as write

    keys = list(key_cols)
    if buckets is None:
        buckets = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if materialize:
            buckets = max(buckets, -(-chunks.count() // CHUNKS_PER_BUCKET))
    base = chunks.select(*keys, F.col(text_col).alias("__text")).repartition(buckets, *keys)
    tf = bucketed_table(count_terms(base, keys, "__text"), keys, buckets, "tf", clustered=True)
    rows, chunk_keys = tf.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).first()
    if rows and rows > chunk_keys:
        tf = bucketed_table(_unite_counts(tf, keys), keys, buckets, "tf", clustered=True)
    stats = tf.select(F.inline("terms")).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    n_row = tf.agg(F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("total"), F.count(F.lit(1)).alias("df"))
    # written: the weights are computed from its rows
    vocab = write(top_vocabulary(stats.unionByName(n_row), max_features))
    if not materialize:
        return TfidfIndex(vocab, weigh_counts(tf, vocab, keys), keys)
    # one row a chunk: neither sorted nor gathered again by the scoring, which has nothing to exchange
    vectors, words = weigh_vectors(tf, vocab, keys)
    vectors = write(vectors)
    return TfidfIndex(vocab, vector_rows(vectors, words, keys), keys, vectors=vectors, words=words)


def _fields(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def count_terms(chunks: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """D1-D3 with one row a chunk: ``(key..., terms array<struct<term, tf>>)``,
    where chunks without terms have an empty array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    stop = pa.array(sorted(ENGLISH_STOP_WORDS))

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            found = lists.flatten().dictionary_encode()
            words, code = found.dictionary, found.indices.to_numpy()
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[code]
            cells, tf = np.unique(row[kept] * len(words) + code[kept], return_counts=True)
            row, code = np.divmod(cells, max(len(words), 1))
            ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
            terms = pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(tf, pa.int64())], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), terms)], names=batch.schema.names)

    toks = chunks.select(*key_cols, tokens_expr(text_col).alias("terms"))
    return toks.mapInArrow(run, f"{_fields(chunks, key_cols)}, terms array<struct<term:string,tf:bigint>>")


def _unite_counts(tf: DataFrame, key_cols: list[str]) -> DataFrame:
    """Counts of :func:`count_terms` with one row a key: chunks that share
    one count as one chunk."""
    each = tf.select(*key_cols, F.inline_outer("terms")).groupBy(*key_cols, "term").agg(F.sum("tf").alias("tf"))
    entry = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return each.groupBy(*key_cols).agg(F.collect_list(entry).alias("terms"))


def _weigher(vocab: DataFrame):
    """The terms of ``vocab``, and a function that gives the row, the number of
    the term and the weight of every entry of lists of :func:`count_terms`: tf *
    idf over the vocabulary, L2-normalised per row.  ``vocab`` is bounded by
    ``max_features`` and goes to the tasks as two Arrow columns."""
    import numpy as np
    import pyarrow.compute as pc

    known = vocab.select("term", "idf").toArrow()
    words, idf = known["term"].combine_chunks(), known["idf"].to_numpy()

    def weighed(lists):
        flat = lists.flatten()
        code = pc.fill_null(pc.index_in(flat.field(0), value_set=words), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        kept = code >= 0
        row, code = row[kept], code[kept]
        weight = flat.field(1).to_numpy()[kept] * idf[code]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(lists)))
        return row, code, weight / norm[row]

    return words, weighed


def weigh_counts(tf: DataFrame, vocab: DataFrame, key_cols: list[str]) -> DataFrame:
    """D6 of rows of :func:`count_terms`: ``(key..., term, weight)``."""
    import pyarrow as pa

    words, weighed = _weigher(vocab)

    def run(batches):
        for batch in batches:
            row, code, weight = weighed(batch.column(batch.num_columns - 1))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(at) for c in batch.columns[:-1]), words.take(pa.array(code)), pa.array(weight)],
                names=[*batch.schema.names[:-1], "term", "weight"])

    return tf.select(*key_cols, "terms").mapInArrow(run, f"{_fields(tf, key_cols)}, term string, weight double")


def weigh_vectors(tf: DataFrame, vocab: DataFrame, key_cols: list[str]) -> tuple[DataFrame, list]:
    """D6 with one row a chunk: ``(key..., __v array<struct<__n, weight>>)`` and
    the terms by their number ``__n``."""
    import numpy as np
    import pyarrow as pa

    words, weighed = _weigher(vocab)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            row, code, weight = weighed(lists)
            ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(code.astype(np.int32)), pa.array(weight)], names=["__n", "weight"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), entries)],
                                             names=[*batch.schema.names[:-1], "__v"])

    out = tf.select(*key_cols, "terms").mapInArrow(run, f"{_fields(tf, key_cols)}, __v array<struct<__n:int,weight:double>>")
    return out, words.to_pylist()


def vector_rows(vectors: DataFrame, words: list, key_cols: list[str], numbers: list | None = None) -> DataFrame:
    """The entries of rows of :func:`weigh_vectors` as ``(key..., term, weight)``;
    with ``numbers`` those of these terms only."""
    rows = vectors.select(*key_cols, F.inline("__v"))
    if numbers is not None:
        rows = rows.where(F.col("__n").isin(numbers)) if numbers else rows.limit(0)
    named = vectors.sparkSession.createDataFrame(list(enumerate(words)), "__n int, term string")
    return rows.join(F.broadcast(named), "__n").select(*key_cols, "term", "weight")


def top_vocabulary(stats: DataFrame, max_features: int) -> DataFrame:
    """D4 + D5: the ``max_features`` most frequent terms and their smooth
    idf.  ``stats`` carries one null-term row whose ``df`` is N."""
    top = (
        stats.where(F.col("term").isNotNull())
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(max_features)
        .select("term", "df")
    )
    n_row = stats.where(F.col("term").isNull()).select("term", "df")
    # At most max_features + 1 rows: the vocabulary is bounded by
    # construction, so a window over all of it is a bounded single task.
    both = top.unionByName(n_row)
    n_docs = F.max(F.when(F.col("term").isNull(), F.col("df"))).over(Window.partitionBy())
    out = both.withColumn("n_docs", n_docs).where(F.col("term").isNotNull())
    return out.select(
        "term",
        F.col("df").cast("long").alias("df"),
        smooth_idf(F.col("n_docs"), F.col("df")).alias("idf"),
        F.col("n_docs").cast("long").alias("n_docs"),
    )


def smooth_idf(n, df):
    """``ln((1+N)/(1+df)) + 1``."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + df)) + F.lit(1.0)


def weigh_postings(tf: DataFrame, vocab: DataFrame, key_cols: list[str]) -> DataFrame:
    """Tf * idf over the vocabulary, L2-normalised per key.  The
    vocabulary is bounded by ``max_features``, so it is broadcast."""
    joined = tf.join(F.broadcast(vocab.select("term", "idf")), "term")
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy(*key_cols)))
    return joined.select(*key_cols, "term", (w / norm).alias("weight"))


def transform_queries(index: TfidfIndex, queries: DataFrame, id_col: str = "query_id",
                      text_col: str = "question", normalized: bool = False) -> DataFrame:
    """Query vectors ``(query_id, term, qweight)`` with the fitted
    vocabulary and idf; unseen terms are ignored.  The text is normalised
    with B2 first unless ``normalized``."""
    text = F.col(text_col) if normalized else normalize_query(text_col)
    base = queries.select(F.col(id_col).alias("query_id"), text.alias("__text")).repartition("query_id")
    tf = term_frequency(base, ["query_id"], "__text")
    w = weigh_postings(tf, index.vocab, ["query_id"])
    return w.withColumnRenamed("weight", "qweight")


def question_index(qa: DataFrame, max_features: int = DEFAULT.max_features) -> TfidfIndex:
    """Fallback index over the questions of processed Q&A rows, one
    'chunk' per row (``chunk_idx = 0``), answers returned by key."""
    rows = qa.select("question_idx", F.lit(0).cast("long").alias("chunk_idx"), "question")
    return fit_index(rows, ["question_idx", "chunk_idx"], "question", max_features)

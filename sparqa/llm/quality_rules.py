"""Quality rules: plain rules on text statistics, and robust multivariate
outliers.

Per language and source the log-transformed statistics of the documents get a
minimum-covariance-determinant estimate: the mean and covariance of the h rows
whose covariance has the smallest determinant.  It is searched from many starts.
Small random subsets of a bounded random sample of each group, and its medians,
are concentrated on the sample (mean and covariance of the h nearest rows, again
and again); the starts of the smallest determinants, and the classical estimate,
are concentrated on all rows; the best of them is iterated until its determinant
no longer falls.  Rows far from their group's estimate are rejected.

All starts of all groups take a step in one aggregation, keyed by group, start
and distance bin.  A group is never gathered: only its moments by bin are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

SYMBOLS = "#*$%&|<>"
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
#: features are whole numbers of 1/SCALE, so that sums do not depend on the order of rows
SCALE = 1000
#: standard deviation added to each feature: a numerical ridge for the continuous two; a count that
#: is 0 in the central rows has no variance of its own, so its floor is that of rounding to the least
#: step in 100 words (step / sqrt(12): one symbol or line is log1p(1), one repeat of three words log1p(6))
FLOOR = (0.01, 0.01, 0.2, 0.2, 0.56)
#: random starts, rows of each (one more than features), rows of the sample they are first tried on
STARTS, START_ROWS, SAMPLE_ROWS = 30, 6, 500
#: steps of every start on the sample and on all rows, starts kept in between, and steps of the best start at most
FIRST_STEPS, KEPT_STARTS, MOST_STEPS = 2, 3, 12
SEED = 10
#: share of a group's rows that the estimate rests on
SUPPORT = 0.75
#: groups of fewer rows are judged with all rows of their language, languages of fewer with all rows
LEAST_ROWS = 50
#: 0.999 quantile of chi-square with 5 degrees of freedom, and the consistency factor of the central
#: 75 % of normal rows (0.75 / P(chi2_7 <= 0.75 quantile of chi2_5)): their covariance is too small by it
QUANTILE, CONSISTENCY = 20.515, 1.41207
#: rejected beyond this squared distance to the estimate as it stands, not scaled up
CUTOFF = QUANTILE * CONSISTENCY


def text_statistics(text: Column) -> dict[str, Column]:
    """Arrays and counts of one text, as named expressions to be added in this
    order (later ones use earlier names)."""
    trigrams = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("__words") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    # trigram places sorted by trigram: equal neighbours are repeats
    by_gram = F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeated = F.filter("__sorted", lambda x, k: (x["g"] == F.get("__sorted", k - 1)["g"]) | (x["g"] == F.get("__sorted", k + 1)["g"]))
    places = F.sort_array(F.transform("__twice", lambda x: x["i"]))
    # a place covers three words, fewer if the next repeated place starts among them
    covered = F.aggregate(
        "__places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(p - acc["last"], F.lit(3))).alias("n"), p.alias("last")), lambda acc: acc["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    return {
        "__words": F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda x: x != ""),
        "__lines": lines,
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__grams": F.when(F.size("__words") < 3, F.array().cast("array<bigint>")).otherwise(trigrams),
        "__sorted": F.when(F.size(F.array_distinct("__grams")) == F.size("__grams"),
                           F.array().cast("array<struct<g:bigint,i:int>>")).otherwise(by_gram),
        "__twice": repeated,
        "__places": places,
        "n_repeat_words": covered,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row: the ``carry`` columns, lang, source, the five counts,
    base_failed); null texts count as empty."""
    df = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
                     F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    for name, value in text_statistics(F.col("__text")).items():
        df = df.withColumn(name, value)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select("row", "lang", "source", *COUNTS, failed.alias("base_failed"))


def _features(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))

    def per_hundred(c):
        return F.log1p(100.0 * F.col(c) / n)

    values = {"x_words": F.log1p(F.col("n_words")), "x_length": F.log((F.col("word_chars") + 1) / n),
              "x_symbols": per_hundred("n_symbols"), "x_lines": per_hundred("n_dup_lines"), "x_repeats": per_hundred("n_repeat_words")}
    return df.withColumns({k: F.round(v * SCALE).cast("long") for k, v in values.items()})


P = range(len(FEATURES))
PAIRS = [(i, j) for i in P for j in P if j <= i]
SUMS = [f"s{i}" for i in P] + [f"q{i}{j}" for i, j in PAIRS]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, sums and sums of products of the features per group (exact)."""
    wide = [F.col(x).cast("decimal(20,0)") for x in FEATURES]
    sums = [F.sum(FEATURES[i]).cast("decimal(38,0)").alias(f"s{i}") for i in P]
    prods = [F.sum((wide[i] * wide[j]).cast("decimal(28,0)")).alias(f"q{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)


def _estimate(moments: DataFrame, by: list[str]) -> DataFrame:
    """Means and the lower triangular inverse factor of each group's covariance
    (plus the floors): the squared distance is a sum of squares."""
    p = P
    df = moments.select(*by, *[F.col(c).cast("double").alias(c) for c in ("n", *SUMS)])
    for i in p:
        df = df.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n") / SCALE)
    for i in p:  # Cholesky factor, row by row
        for j in range(i + 1):
            c = F.col(f"q{i}{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")
            c = c + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor bounds the pivot from below; rounding must not undo that
            c = F.sqrt(F.greatest(c, F.lit(FLOOR[i] ** 2 / 2))) if i == j else c / F.col(f"l{j}{j}")
            df = df.withColumn(f"l{i}{j}", c)
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in p), F.lit(0.0))
    return df.select(*by, *[f"m{i}" for i in p], *[f"l{i}{j}" for i, j in PAIRS], logdet.alias("logdet"))


def _distance(df: DataFrame, name: str = "d2") -> DataFrame:
    """Forward substitution with the group's factor."""
    total = F.lit(0.0)
    for i in range(len(FEATURES)):
        z = F.col(FEATURES[i]) / F.lit(float(SCALE)) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"__z{j}")
        df = df.withColumn(f"__z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"__z{i}") * F.col(f"__z{i}")
    df = df.withColumn(name, total)
    return df.drop(*[f"__z{i}" for i in range(len(FEATURES))], *[f"m{i}" for i in range(len(FEATURES))],
                   *[f"l{i}{j}" for i in range(len(FEATURES)) for j in range(i + 1)], "logdet")


def _step(rows: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """The estimates of the h = SUPPORT rows of each group nearest to
    ``estimate``.  Moments are gathered by bins of distance (1/16 octave: a few
    hundred a group); of the bin in which the h-th row lies, the part that is
    needed counts."""
    near = _distance(rows.join(_small(estimate), by)).withColumn("bin", F.floor(16 * F.log2(F.col("d2") + F.lit(1e-6))))
    bins = _moments(near, [*by, "bin"])
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0))).withColumn("h", F.ceil(SUPPORT * F.sum("n").over(Window.partitionBy(*by))))
    bins = bins.where("before < h")
    whole = F.col("before") + F.col("n") <= F.col("h")
    part = (F.col("h") - F.col("before")) / F.col("n")

    def total(c):  # exact over whole bins, and the part of one bin
        return (F.coalesce(F.sum(F.when(whole, F.col(c))), F.lit(0)).cast("double") + F.coalesce(F.sum(F.when(~whole, F.col(c).cast("double") * part)), F.lit(0.0))).alias(c)

    return _estimate(bins.groupBy(*by).agg(*[total(c) for c in ("n", *SUMS)]), by)


def _best(estimates: DataFrame, by: list[str], kept: int) -> DataFrame:
    """The ``kept`` estimates of smallest determinant of each group."""
    order = Window.partitionBy(*by).orderBy("logdet", "start")
    return estimates.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= kept).drop("__r")


def minimum_determinant(fit: DataFrame, by: list[str]) -> DataFrame:
    """The estimate of each group of ``fit`` (stored; ``by``, draw, features):
    means, inverse factor and ``logdet``."""
    order = Window.partitionBy(*by).orderBy("draw", *FEATURES)
    sample = stored(fit.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= SAMPLE_ROWS).drop("__r"), "sample")
    tries = sample.select(*by, "draw", *FEATURES, F.explode(F.sequence(F.lit(1), F.lit(STARTS))).alias("start"))
    chance = Window.partitionBy(*by, "start").orderBy(F.xxhash64("start", "draw"), *FEATURES)
    first = tries.withColumn("__r", F.row_number().over(chance)).where(F.col("__r") <= START_ROWS)
    keyed = [*by, "start"]
    middle = _middle(sample, by)
    estimate = stored(_estimate(_moments(first, keyed), keyed).unionByName(middle), "starts")
    everywhere = stored(sample.select(*by, *FEATURES, F.explode(F.sequence(F.lit(0), F.lit(STARTS))).alias("start")), "tries")
    for _ in range(FIRST_STEPS):
        estimate = stored(_step(everywhere, estimate, keyed), "starts")
    classical = _estimate(_moments(fit, by), by).withColumn("start", F.lit(-1))
    estimate = stored(_best(estimate, by, KEPT_STARTS).unionByName(classical.select(*estimate.columns)), "starts")
    several = _each_start(fit, estimate, by)
    for _ in range(FIRST_STEPS):
        estimate = stored(_step(several, estimate, keyed), "starts")
    best = stored(_best(estimate, by, 1).drop("start"), "best")
    for _ in range(MOST_STEPS):
        after = stored(_step(fit, best, by), "best")
        fell = after.select(*by, F.col("logdet").alias("now")).join(best.select(*by, "logdet"), by).where(F.col("now") < F.col("logdet") - 1e-6)
        best = after
        if fell.isEmpty():
            break
    return best


def _each_start(fit: DataFrame, estimate: DataFrame, by: list[str]) -> DataFrame:
    """The rows of each group once for each of its starts."""
    starts = stored(estimate.groupBy(*by).agg(F.collect_list("start").alias("starts")), "kept_starts")
    return fit.join(_small(starts), by).select(*by, *FEATURES, F.explode("starts").alias("start"))


def _middle(sample: DataFrame, by: list[str]) -> DataFrame:
    """Start 0: medians, and independent features with the deviations that the
    median absolute deviations stand for."""
    medians = sample.groupBy(*by).agg(*[F.percentile(x, F.lit(0.5)).alias(f"c{i}") for i, x in enumerate(FEATURES)])
    apart = sample.join(_small(stored(medians, "medians")), by)
    mads = apart.groupBy(*by).agg(*[F.first(f"c{i}").alias(f"c{i}") for i in P],
                                  *[(1.4826 * F.percentile(F.abs(F.col(x) - F.col(f"c{i}")), F.lit(0.5))).alias(f"v{i}") for i, x in enumerate(FEATURES)])
    # as moments of one row: their covariance is diagonal
    c, v = [F.col(f"c{i}") for i in P], [F.col(f"v{i}") for i in P]
    moments = mads.select(*by, F.lit(0).alias("start"), F.lit(1).alias("n"), *[c[i].alias(f"s{i}") for i in P],
                          *[(c[i] * c[j] + (v[i] * v[i] if i == j else 0)).alias(f"q{i}{j}") for i, j in PAIRS])
    return _estimate(moments, [*by, "start"])


#: groups whose estimates are broadcast; more are joined by a shuffle that can split hot groups
BROADCAST_GROUPS = 5_000


def _small(groups: DataFrame) -> DataFrame:
    """``groups`` marked for broadcast if it has few rows."""
    if len(groups.limit(BROADCAST_GROUPS + 1).select(F.lit(1)).collect()) <= BROADCAST_GROUPS:
        return F.broadcast(groups)
    return groups


def robust_distances(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, source, features) with ``d2``: the squared distance to
    the minimum-determinant estimate of the row's group."""
    # plain rules reject their rows whatever the distance; the estimate rests on the others
    passed = F.sum(F.when(~F.col("base_failed"), 1).otherwise(0))
    sizes = stored(rows.groupBy("lang", "source").agg(passed.alias("group_rows")), "sizes")
    languages = sizes.groupBy("lang").agg(F.sum("group_rows").alias("lang_rows"))
    # small groups lean on all rows of their language, small languages on all rows
    level = F.when(F.col("group_rows") >= LEAST_ROWS, F.concat(F.lit("="), F.col("source"))).when(F.col("lang_rows") >= LEAST_ROWS, "").otherwise("*")
    groups = sizes.join(languages, "lang").select("lang", "source", F.when(level == "*", "").otherwise(F.col("lang")).alias("glang"), level.alias("grp"))
    rows = rows.join(_small(groups), ["lang", "source"])
    by = ["glang", "grp"]
    fit = rows.where("not base_failed")
    parts = fit.where("grp like '=%'").select(*by, "draw", *FEATURES)
    if groups.where("grp = ''").limit(1).collect():
        parts = parts.unionByName(fit.join(_small(languages.where(F.col("lang_rows") >= LEAST_ROWS).select("lang")), "lang").select(
            F.col("lang").alias("glang"), F.lit("").alias("grp"), "draw", *FEATURES))
    if groups.where("grp = '*'").limit(1).collect() and (sizes.agg(F.sum("group_rows")).first()[0] or 0) >= LEAST_ROWS:
        parts = parts.unionByName(fit.select(F.lit("").alias("glang"), F.lit("*").alias("grp"), "draw", *FEATURES))
    fit = stored(parts, "fit")
    estimate = minimum_determinant(fit, by)
    return _distance(rows.join(_small(estimate), by, "left")).drop(*by)


def _judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    stats = _features(statistics(docs, carry))
    draw = F.xxhash64(F.lit(SEED), F.col("row.doc_id"), *FEATURES)
    out = robust_distances(stored(stats.withColumn("draw", draw), "statistics"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CUTOFF)
    return out.select("row", *COUNTS, "base_failed", F.col("d2").alias("distance"), kept.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    distance, kept.

    ``kept`` is false for a failed plain rule or a squared distance above
    CUTOFF.  Null texts count as empty and fail the plain rule; null languages
    and sources are groups of their own (``""``); where fewer than LEAST_ROWS
    rows of the whole table pass the plain rules, small languages have no
    estimate, and nothing there is rejected by distance.  Repeated rows are judged alike and all returned; whole texts
    count, whatever their length; other columns are not read; an empty table
    gives an empty result."""
    return _judged(docs, ["doc_id"]).select("row.doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    return _judged(docs, docs.columns).where("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Personal data, and terms that give it away.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and
check digit.  Information-theoretic sanitisation adds terms: co-occurrence over
the whole texts of the corpus estimates how probable a protected entity is
given a term.  Entities are the values that several texts hold, and each kind of
value as a whole (so that values seen once count too).  A term whose pointwise
mutual information with an entity is most of the entity's own information is
generalised, one that reveals nearly all of it is removed - at every place where
it stands, in every document.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, stored

KINDS = ("email", "ip", "card", "phone")
#: The patterns are those of the contract, with possessive repeats and look-behinds that
#: match the same spans in linear time (a run of characters is tried once, not from each
#: of its places, and long digit runs do not recurse).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: characters without which a pattern cannot match
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
TERM = r"[\p{L}\p{M}]{3,}"
#: share of an entity's information that a term may reveal before it is generalised / removed
GENERALISE, REMOVE = 0.8, 0.95
#: rows (disclosing terms, texts that hold some) that are broadcast; more are joined by a shuffle
BROADCAST_ROWS = 50_000
_BLOCK = 256


def _running(values: Column) -> Column:
    """Sums of the elements before each element, in two levels so that long
    arrays stay far from quadratic."""
    def scan(xs, first):
        return F.slice(F.aggregate(xs, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))), 1, F.size(xs))

    zero = F.lit(0).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, (b * _BLOCK + 1).cast("int"), _BLOCK))
    sums = F.transform(parts, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    return F.flatten(F.zip_with(parts, scan(sums, zero), scan))


def _lengths(values: Column) -> Column:
    return F.transform(values, lambda x: F.length(x).cast("long"))


def with_matches(df: DataFrame, text: str, pattern: str, name: str, possible: Column) -> DataFrame:
    """Adds array ``name`` of (start, end, value) of the pattern's leftmost
    non-overlapping matches, in code points: the text's pieces between matches
    and the matches give the offsets."""
    hits, pieces, starts = f"__{name}_hits", f"__{name}_pieces", f"__{name}_starts"
    p = F.lit(pattern)
    df = df.withColumn(hits, F.when(possible, F.regexp_extract_all(text, p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = F.size(hits) > 0
    df = df.withColumn(pieces, F.when(some, _lengths(F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size(hits)))))
    df = df.withColumn(starts, F.when(some, _running(F.zip_with(pieces, _lengths(F.col(hits)), lambda a, b: a + b))))
    found = F.zip_with(F.zip_with(pieces, starts, lambda a, b: a + b), hits, lambda s, v: F.struct(
        s.alias("start"), (s + F.length(v)).alias("end"), v.alias("value")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return df.withColumn(name, F.when(some, found).otherwise(empty)).drop(hits, pieces, starts)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        def step(acc, i):
            d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + d - F.when(d > 9, 9).otherwise(0)
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0
        return F.when(F.length(digits).between(16, 19), luhn).otherwise(F.lit(False))
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, spans, terms): a row per row of ``docs``; (k1, k2)
    identify the text; spans are (kind, start, end, value) by kind, then start;
    terms are the text's distinct words outside of addresses."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), text.alias("__text"))
    df = df.withColumn("__digit", F.rlike("__text", F.lit("[0-9]")))
    for kind in KINDS:
        possible = F.contains("__text", F.lit("@")) if kind == "email" else F.col("__digit") & F.rlike("__text", F.lit(NEEDS[kind]))
        df = with_matches(df, "__text", PATTERNS[kind], kind, possible)

    def spans(kind):
        good = F.filter(kind, lambda s: _valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    outside = F.when(F.size("email") > 0, F.regexp_replace("__text", PATTERNS["email"], " ")).otherwise(F.col("__text"))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(TERM), F.lit(0)), F.lower))
    return df.select("doc_id", "k1", "k2", F.concat(*[spans(k) for k in KINDS]).alias("spans"), terms.alias("terms"))


def _value(kind: Column, value: Column) -> Column:
    """A protected value, however it is written."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (stored) marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def association(both: Column, texts: Column, df: Column, prior: Column) -> Column:
    """Smoothed probability of an entity given a term: ``both`` documents of
    the term's ``df`` hold the entity, ``texts`` of them different.  One text
    alone is no evidence, and a rare term is drawn towards the entity's
    ``prior``."""
    return (1 - 1 / texts) * (both + prior) / (df + 1)


def co_occurrence(base: DataFrame) -> DataFrame:
    """(entity, term, both, texts, df, n_entity): terms that stand in two texts
    or more with an entity, with documents that hold both, the term, the
    entity.  Entities are ``kind:value`` and ``kind:``; counts are over whole
    texts of all documents."""
    held = base.where(F.size("spans") > 0).groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"), F.first("terms").alias("terms"))
    entities = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.array(_value(s["kind"], s["value"]), F.concat(s["kind"], F.lit(":"))))))
    held = stored(held.select(F.monotonically_increasing_id().alias("at"), "copies", "terms", entities.alias("entities")), "protected")
    counts = held.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("entity_texts"), F.sum("copies").alias("n_entity")).where("entity_texts > 1")
    counts = stored(counts.select("entity", "n_entity"), "entities")
    # terms are exploded for entities of several texts only
    known = held.select("at", F.explode("entities").alias("entity")).join(_small(counts), "entity").groupBy("at").agg(
        F.collect_list(F.struct("entity", "n_entity")).alias("known"))
    pairs = held.select("at", "copies", "terms").join(known, "at").select("copies", "terms", F.explode("known").alias("e")).select(
        "copies", F.col("e.entity").alias("entity"), F.col("e.n_entity").alias("n_entity"), F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both")).where("texts > 1")
    # every term is counted before the join, so a frequent term is one row there
    df = base.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return pairs.join(df, "term").select("entity", "term", "both", "texts", "df", "n_entity")


def disclosures(base: DataFrame) -> DataFrame:
    """(term, kind): the terms that disclose an entity, kind being
    ``generalise`` or ``remove``."""
    documents = base.count()
    prior = F.col("n_entity") / F.lit(float(max(documents, 1)))
    revealed = F.log(association(F.col("both"), F.col("texts"), F.col("df"), prior) / prior)
    information = -F.log(prior)
    found = co_occurrence(base).where((information > 0) & (revealed >= GENERALISE * information))
    kind = F.when(revealed >= REMOVE * information, "remove").otherwise("generalise")
    return found.select("term", kind.alias("kind")).groupBy("term").agg(F.max("kind").alias("kind"))  # remove > generalise


def _places(docs: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """(k1, k2, terms): every place of the found terms outside base spans."""
    holds = base.select("k1", "k2", "spans", F.explode("terms").alias("term")).join(_small(found), "term")
    holds = holds.groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.collect_set(F.struct("term", "kind")).alias("found"))
    holds = stored(holds, "holds")
    keyed = docs.select(F.xxhash64(F.lit(1), "text").alias("k1"), F.xxhash64(F.lit(2), "text").alias("k2"), F.col("text").cast("string").alias("__text"))
    rows = with_matches(keyed.join(_small(holds), ["k1", "k2"]), "__text", TERM, "words", F.lit(True))
    kinds = F.map_from_entries(F.transform("found", lambda x: F.struct(x["term"], x["kind"])))
    rows = rows.withColumn("kinds", kinds).withColumn("words", F.transform("words", lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), F.try_element_at("kinds", F.lower(w["value"])).alias("kind"), _shape(w["value"]).alias("class"))))
    hits = F.filter("words", lambda w: w["kind"].isNotNull())
    rows = rows.withColumn("words", hits).select("k1", "k2", F.filter("words", lambda w: ~F.exists(
        "spans", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"]))).alias("terms"))
    # copies of a text have the same places
    return rows.groupBy("k1", "k2").agg(F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"))


def _shape(word: Column) -> Column:
    """The class that a generalised word is replaced by."""
    return F.when(F.rlike(word, F.lit(r"^\p{Lu}{2,}$")), "acronym").when(F.rlike(word, F.lit(r"^\p{Lu}")), "name").otherwise("word")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, k1, k2 (the text's
    key), base (array of kind, start, end, value, by kind then start) and terms
    (array of start, end, kind, class: the places of words that disclose an
    entity, wherever in the corpus they stand).

    Offsets are code points, ends exclusive.  Null texts count as empty; counts
    run over all documents and their whole texts; a term must stand with an
    entity in two different texts at least, so copies of one text alone make
    none disclosing; repeated rows are answered alike; other columns are not
    read; an empty table gives an empty result."""
    base = stored(base_spans(docs), "base_spans")
    found = stored(disclosures(base), "disclosures")
    places = stored(_places(docs, base, found), "places")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,class:string>>")
    rows = lookup(base.drop("terms"), places, ["k1", "k2"], "n", base.count())
    return rows.select("doc_id", "k1", "k2", F.col("spans").alias("base"), F.coalesce("terms", empty).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` sanitised: values become ``[email]`` and so on,
    generalised terms their class (``[name]``, ``[acronym]``, ``[word]``),
    removed terms nothing.  Where spans overlap
    the earlier one stands.  Texts without spans are unchanged."""
    found = find_pii(docs).groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("terms").alias("terms")).where("size(base) + size(terms) > 0")
    marked = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), s["class"], F.lit("]"))).alias("put"))))
    found = found.select("k1", "k2", F.sort_array(marked).alias("__marks"))
    keyed = docs.withColumn("__k1", F.xxhash64(F.lit(1), "text")).withColumn("__k2", F.xxhash64(F.lit(2), "text"))
    rows = keyed.join(found, (F.col("__k1") == found["k1"]) & (F.col("__k2") == found["k2"]), "left").drop("k1", "k2")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate("__marks", start, lambda acc, m: F.when(m["start"] < acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring("text", acc["at"] + 1, m["start"] - acc["at"]), m["put"]).alias("out"), m["end"].alias("at"))))
    rows = rows.withColumn("__done", done)
    clean = F.concat(F.col("__done.out"), F.substring("text", F.col("__done.at") + 1, F.length("text")))
    return rows.withColumn("text", F.coalesce(clean, F.col("text"))).select(*docs.columns)

"""URL allow and block lists by a trie.

The trie goes down reversed host labels, then path segments; a rule sits at
the node of its host and whole path segments, with what follows its path's
last slash as a prefix of the next segment.  Lists within a checked size are
broadcast as one trie; larger ones are joined on (host suffix, path prefix).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: rules (and characters of them) that are broadcast as a trie at most
BROADCAST_RULES, BROADCAST_CHARS = 200_000, 16 << 20
DEFAULT = "allow"


def host_column(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url):
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """``match(host, path)``: the longest fitting rule as (host, path, verdict), or None."""

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault(0, {})  # from labels to path segments
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(1, []).append((last, host, path, verdict))

    def match(self, host: str, path: str):
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            here = node.get(0)
            for segment in segments:
                if here is None:
                    break
                for last, h, p, verdict in here.get(1, ()):
                    if segment.startswith(last):
                        key = (len(h) + len(p), len(h), verdict == "block")
                        if best is None or key > best[0]:
                            best = (key, (h, p, verdict))
                here = here.get(segment)
        return best and best[1]


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """``pages`` with added host, path, rule (host and path of the rule, null
    without one) and verdict (the rule's, else ``default``).

    A rule fits its host and all subdomains if the path starts with the
    rule's path.  The longest rule (characters of host and path) wins; of equal
    ones that with the longer host, then block.  ``rules`` is a sequence of
    (host, path, verdict) or a DataFrame with these columns; rules with a null
    part never fit.  Null urls and urls without ``://`` have an empty host and
    path; an empty host fits only a rule with an empty host.  Repeated rows are
    judged one by one; columns of ``pages`` with the added names are replaced;
    an empty table stays empty."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*keep, host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").dropna().distinct()
        n, chars = rules.agg(F.count(F.lit(1)), F.sum(F.length("host") + F.length("path"))).first()
        if n > BROADCAST_RULES or chars > BROADCAST_CHARS:
            return _joined(parts, rules, keep, default)
        rules = [tuple(r) for r in rules.collect()]
    rules = [r for r in rules if None not in r]
    if len(rules) > BROADCAST_RULES or sum(len(h) + len(p) for h, p, _ in rules) > BROADCAST_CHARS:
        return _joined(parts, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), keep, default)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def look_up(host: pa.Array, path: pa.Array) -> pa.Array:
        trie = _trie(shared)
        out = [trie.match(h, p) for h, p in zip(host.to_pylist(), path.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array([m and m[0] + m[1] for m in out], pa.string()),
             pa.array([m[2] if m else default for m in out], pa.string())], ["rule", "verdict"])

    found = parts.withColumn("__m", look_up("host", "path"))
    return found.select(*keep, "host", "path", F.col("__m.rule").alias("rule"), F.col("__m.verdict").alias("verdict"))


_TRIES: dict = {}


def _trie(shared) -> Trie:
    """The trie of a broadcast rule list, built once per worker process."""
    if shared.value and _TRIES.get("of") is not shared.value:
        _TRIES.update(of=shared.value, trie=Trie(shared.value))
    return _TRIES["trie"] if shared.value else Trie(())


def _joined(parts, rules, keep, default) -> DataFrame:
    """The same by a join: each distinct (host, path) meets the rules at its
    host suffixes and whole-segment path prefixes."""
    pairs = parts.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    up = pairs.select("host", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("h"))
    up = up.select("host", "path", "h", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i - 1), "/"))).alias("whole"))
    r = rules.select(F.col("host").alias("h"), F.col("path").alias("rule_path"), F.col("verdict").alias("v"),
                     F.regexp_replace("path", r"(?s)(^|/)[^/]*$", "").alias("whole"))
    fits = up.distinct().join(r, ["h", "whole"]).where(F.startswith("path", "rule_path"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("h") + F.length("rule_path")).alias("n"), F.length("h").alias("hn"), (F.col("v") == "block").alias("b"),
        F.concat("h", "rule_path").alias("rule"), "v")).alias("m"))
    return parts.join(best, ["host", "path"], "left").select(
        *keep, "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict"))

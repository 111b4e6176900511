import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from sparqa.llm import prefix_trie

from .helpers import SPACE

TURNS = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """Own turns of every conversation, then the shared starts."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    below = {}
    for k in sorted(members, key=len, reverse=True):
        leaves, saved = (0, 0) if children[k] else (1, 0)
        for x in children[k]:
            leaves, saved = leaves + below[x][0], saved + below[x][1]
        below[k] = leaves, saved + (len(members[k]) - 1) * (len(SPACE.findall(k[-1][1])) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(conversations[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def grown(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(df.columns) == sorted(names)
    return sorted(tuple(r[c] for c in names) for r in df.collect())


def conversations(seed, count, alphabet, most):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 4 * count), count):
        for t in range(r.choice([0, 1, 2, 3, most])):
            rows.append((c, t, r.choice(["user", "assistant", None]) if alphabet > 2 else "user", f"say {r.randrange(alphabet)} " * r.randrange(4)))
    # copies of one long conversation, some cut short
    long = [("user", f"turn {i} of many") for i in range(120)]
    for j in range(60):
        rows += [(10_000 + 20 * j, t, *x) for t, x in enumerate(long[: 120 if j % 3 else 119 - j])]
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "fan"), [(1, 1, 64), (2, 2, 2), (3, 5, 2), (4, 40, 64)])
def test_same_trie_as_brute_force(spark, monkeypatch, seed, alphabet, fan):
    """Few and many different turns, copies, prefixes of each other; several
    rounds of uniting partitions."""
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    rows = conversations(seed, 300, alphabet, 9)
    random.Random(seed).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = grown(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rebuild(rows))


def test_odd_rows(spark):
    """Nulls in every column, equal turns, repeated rows, turnless rebuilt
    conversations, long texts, rows without a conversation."""
    rows = [(0, None, "a", "first"), (0, 0, None, None), (0, 0, "b", "tie"), (0, 0, "b", "tie"), (None, 0, "x", "nowhere"), (None, None, None, None),
            (1, 5, "", ""), (2, 0, "a", "word " * 50_000), (3, 0, "a", " \t\n"), (-7, 1, "a", "minus"), (-7, None, "a", "é 日本")]
    # conversations whose base is absent and that have no more than h turns rebuild to nothing
    rows += [(c, 0, "user", "only") for c in range(401, 420)]
    odd = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS depth", "'y' AS n", "1 AS key", "2 AS seq", "3 AS grp", "4 AS turns")
    want = brute(rebuild(rows))
    assert any(d == 0 and e != hashlib.sha256(b"").hexdigest() for _, d, *_, e in want)
    assert grown(prefix_trie.conversation_trie(odd)) == want


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], TURNS)
    assert grown(prefix_trie.conversation_trie(empty)) == []
    one = [(20, 0, "u", "a b"), (20, 1, "v", "c")]
    assert grown(prefix_trie.conversation_trie(spark.createDataFrame(one, TURNS))) == brute(rebuild(one))


def test_many_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 3)
    members = spark.createDataFrame([(bytes([c % 2]), c) for c in range(-30, 500)], "key binary, conv_id long").repartition(5)
    got = {r.key[0]: r.sha for r in prefix_trie._member_hashes(members).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for c in range(-30, 500) if c % 2 == k).encode()).hexdigest() for k in (0, 1)}

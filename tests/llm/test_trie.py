"""The prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from martloom.llm import queries, trie

COLUMNS = "conv_id long, turn long, role string, text string, at int, digest long, a string, band array<int>"


def brute(rows, step=5, most=9):
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            told[c].append(((turn is not None, turn or 0, digest), (role, text)))
    told = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in told.items()}
    whole = {}
    for c in told:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % step) * (1 if c >= 0 else -1)
        whole[c] = tuple(told.get(base, [])[:h] + told[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    end = lambda n, m: ",".join(map(str, sorted(c for c in m if whole[c] == n)))
    return sorted([(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(end(n, m).encode()).hexdigest()) for n, m in members.items()], key=str)


def shared(r, n):
    """Conversations over few turns, so that many begin alike; some long, some odd."""
    rows = []
    for c in [*range(n), -3, -5, 10**12, 2**62]:
        size = r.choice([0, 1, 2, 3, 9, 12, 40])
        rows += [(c, t, r.choice(["user", "user", "assistant", None]), r.choice(["hé", "hé", "x" * 30, "", None]))
                 for t in range(size)]
    same = [(t, "user", f"t{t}") for t in range(70)]
    rows += [(c, *x) for c in (105, 106, 1005, 1006, 1007) for x in same]  # copies
    rows += [(3, None, "user", "null turn"), (3, None, "user", "null turn"), (3, 1, "b", "tie"), (3, 1, "a", "tie"),
             (None, 0, "user", "nobody's"), (8, 5, None, None), (0, 0, "user", "the first")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("height,wide", [(2, 1), (3, 10**6), (16, 3)])
def test_trie_of_odd_conversations(spark, height, wide):
    rows = shared(random.Random(height), 40)
    df = spark.createDataFrame([(*x, 1, 2, "a", [3]) for x in rows], COLUMNS).repartition(3)
    got = trie.trie(trie.rebuilt(trie.turns(df)), height, wide).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_trie_without_lending(spark):
    """The operator itself, on rows of its own: one deep conversation, one that ends early."""
    rows = [(c, d, f"t{d}" if d else "", d, d == n) for c, n in ((1, 100), (2, 60), (3, 0)) for d in range(n + 1)]
    df = spark.createDataFrame(rows, "conv_id long, depth long, digest string, bytes long, last boolean")
    got = {(r.conv_id, r.depth): r for r in trie.trie(df, height=4).collect()}
    assert len(got) == 101 and got[1, 0].n_leaves == 1 and got[1, 0].n_convs == 3
    assert got[1, 0].saved_tokens == got[1, 1].saved_tokens == sum(range(1, 61)) and got[1, 61].saved_tokens == 0
    assert got[1, 60].ends_sha256 == hashlib.sha256(b"2").hexdigest() and got[1, 60].n_children == 1


def test_ends_of_many_and_nothing(spark):
    ids = [*range(0, 20_000, 3), *range(-9000, 0, 7)]
    df = spark.createDataFrame([(i, 0, 0, True) for i in ids], "conv_id long, a long, b long, last boolean")
    [row] = trie.ends(df.repartition(5)).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    none = spark.createDataFrame([], COLUMNS)
    assert trie.trie(trie.rebuilt(trie.turns(none))).count() == 0


def test_query(spark, tmp_path):
    rows = shared(random.Random(9), 15)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert dict(got.dtypes) == {**dict.fromkeys(
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint"),
        "ends_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert got.filter(F.col("parent_conv_id").isNull()).count() == 1

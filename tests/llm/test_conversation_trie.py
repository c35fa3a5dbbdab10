"""The prefix trie of conversations against a trie in memory, and subtree totals on trees of all shapes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runlens.llm import conversation_trie as ct
from runlens.llm.queries import QUERIES
from runlens.llm.running import running_totals

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, node long, depth long, conv string"


def plain_trie(rows):
    """Ties of a turn must be equal rows."""
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + t[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                kids[tuple(t[:d - 1])].add(tuple(t[:d]))
    total, out = {}, []
    for key in sorted(members, key=len, reverse=True):
        own_words = (len(members[key]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        below = [total[k] for k in kids[key]]
        total[key] = (sum(x for x, _ in below) or 1, own_words + sum(y for _, y in below))
        ends = sorted(c for c in members[key] if len(built[c]) == len(key))
        out.append((
            min(members[key]), len(key), min(members[key[:-1]]) if key else None, len(members[key]), len(kids[key]), *total[key],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(6)
    assert Counter(map(tuple, ct.conversation_trie(df).collect())) == plain_trie(rows)


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(300):
        if c % 7 == 3:
            continue  # also first conversations of families are missing
        same = rng.random() < 0.4
        for t in range(rng.randrange(0, 9)):
            text = f"hello {t}" if same else rng.choice(["a", "b b", None, "", " \t "])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None, ""]) if not same else "user", text))
    rows = [r for k, r in enumerate(rows) if (r[0], r[1]) not in {x[:2] for x in rows[:k]}]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, 0, "u", "only one turn, its head is taken from conversation 0 that is absent")])
    check(spark, [(0, None, None, None), (0, 1, "u", "a"), (0, 1, "u", "a"), (None, 1, "u", "x"), (3, -2, "u", "漢字 é"), (3, 5, "", "w " * 9000)])
    check(spark, [(c, 0, "u", "same first turn") for c in range(200)] + [(c, 1, "a", "same reply") for c in range(200)])
    df = spark.createDataFrame([], SCHEMA)
    assert ct.conversation_trie(df).count() == 0
    assert ct.conversation_trie(spark.createDataFrame([(None, 1, "u", "x", 1, 1, "x")], SCHEMA)).count() == 0


def test_a_long_conversation_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(40, t, "user", f"turn {t % 3}") for t in range(700)] + [(41, t, "user", f"turn {t % 3}") for t in range(650)]
    rows += [(c, t, "user", f"turn {t}") for c in range(60, 90) for t in range(5)]
    check(spark, rows)
    df = spark.createDataFrame([(7, k, 1) for k in range(2000)], "g long, k long, one long")
    found = running_totals(df, "g", [F.asc("k")], {"at": "one"}).withColumn("part", F.spark_partition_id())
    assert found.where("at <> k + 1").count() == 0 and found.select("part").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("shape", ["chain", "star", "caterpillar", "random", "binary", "forest"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    n = 400
    parent = {
        "chain": lambda k: k - 1, "star": lambda k: 0, "caterpillar": lambda k: k - 1 if k % 2 else max(0, k - 2),
        "random": lambda k: rng.randrange(k), "binary": lambda k: (k - 1) // 2, "forest": lambda k: k - 1 if k % 50 else None,
    }[shape]
    up = {0: None} | {k: parent(k) for k in range(1, n)}
    value, depth = {k: rng.randrange(100) for k in up}, {}
    for k in up:
        depth[k] = 0 if up[k] is None else depth[up[k]] + 1
    want = dict(value)
    for k in sorted(up, key=depth.get, reverse=True):
        if up[k] is not None:
            want[up[k]] += want[k]
    tree = spark.createDataFrame([(k, up[k], depth[k], value[k]) for k in up], "node long, parent long, depth long, v long")
    assert {r.node: r.v for r in ct.subtree_totals(tree, ["v"]).collect()} == want


def test_provided_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op12_conversation_trie"](spark, SF)
    assert {t for _, t in found.drop("ends_sha256").dtypes} == {"bigint"}
    assert Counter(map(tuple, found.collect())) == plain_trie(rows)

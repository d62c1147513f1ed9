import hashlib
import math
import random
import zlib

import pytest
from fixtures import SF, by_row

from placeweave.llm import prefix_trie, queries
from placeweave.llm.prefix_trie import Fingerprint

SCHEMA = "conv_id long, turn long, role string, text string, depth long, conv string, pos int, hi string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "c", 1, "x") for r in rows], SCHEMA).repartition(5)


def brute(rows):
    """All rebuilt conversations as lists, all prefixes as tuples."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append(((-1, 0) if t is None else (0, t), r or "", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = said.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, ends = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, cs in members.items():
        cost = (len(cs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += node not in children
    return by_row((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()) for node, cs in members.items())


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 30), *range(100, 130), *range(205, 220), -3, -100, -150, 10 ** 12 + 7]:
        opening = ["hello", "hi", "good day", "é🙂" * 5][rng.randrange(4)]
        for t in range(rng.randrange(1, 12)):
            rows.append((c, t, ("user", "assistant")[t % 2], opening if t == 0 else rng.choice(["yes", "no", "a longer reply", "", None])))
    rows += [(300, t, "user", "same") for t in range(8)] + [(c, t, "user", "same") for c in range(301, 340) for t in range(8)]
    rows += [(0, t, None if t % 3 else "user", f"turn {t % 5}") for t in range(20, 200)]
    rows += [(405, None, None, None), (405, None, "b", "x"), (405, 1, "a", "z"), (405, 1, "a", "y"), (405, 1, "a", "y"), (406, 0, "u", "v" * 20_000)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows


def result(df):
    return by_row(tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_against_brute_force(spark):
    rows = conversations()
    assert result(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)
    assert prefix_trie.prefix_trie(frame(spark, rows).limit(0)).count() == 0


def test_a_conversation_over_many_partitions(spark):
    rows = [(0, t, "user", f"{t % 7}") for t in range(400)] + [(c, t, "user", f"{t % 7}") for c in (1, 2, 50) for t in range(200)] + [(5, 0, "a", "b")]
    conf, old = spark.conf, spark.conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", "13")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)
    finally:
        conf.set("spark.sql.shuffle.partitions", old)
        conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_shared_fingerprints_are_noticed_and_computed_again(spark):
    rows = conversations()
    weak = Fingerprint(1, (5, 7, 11))
    assert result(prefix_trie.prefix_trie(frame(spark, rows), [weak, Fingerprint(2)])) == brute(rows)
    with pytest.raises(ValueError, match="share a fingerprint"):
        prefix_trie.prefix_trie(frame(spark, rows), [weak])


def test_products_compose(spark):
    by = Fingerprint(7)
    turns = prefix_trie._turns(frame(spark, [(1, t, "u", f"t{t}") for t in range(10)]))
    got = {r.pos: r for r in prefix_trie.stored_products(turns, by).collect()}
    for cut in range(1, 10):
        for m, (base, prime) in enumerate(zip(by.bases, by.primes)):
            rest = (got[10][f"a{m}"] - got[cut][f"a{m}"]) * pow(base, -cut, prime) % prime
            assert (got[cut][f"a{m}"] + pow(base, cut, prime) * rest) % prime == got[10][f"a{m}"]
    assert prefix_trie.classes_hold(turns, by)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_prefix_trie(spark, SF)) == brute(rows)

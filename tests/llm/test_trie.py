import hashlib
import math
import random
import zlib

import pytest

from tests.parity import connected, same
from voxelloom.llm.trie import OP12_SQL, op12_conversation_trie, prefix_trie


def brute(rows):
    """Nodes as tuples of (role, text); everything by its definition."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in convs.items()}
    base = lambda c: c - int(math.fmod(c, 20))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(base(c), [])[:h] + turns[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        return [node, *(x for k in children.get(node, []) for x in below(k))]

    out = []
    for node, of in members.items():
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in of if len(rebuilt[c]) == len(node))))
        saved = sum((len(members[k]) - 1) * (len(k[-1][1].encode().split()) if k else 0) for k in under)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children.get(node, [])), sum(k not in children for k in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-90, 300), 150):
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["a b", "a  b c", "", None, "x" * rng.randrange(3)])))
    want = brute(rows)
    assert result(op12_conversation_trie(made(spark, rows))) == want and any(x[7] != want[0][7] for x in want)


def test_copies_in_many_families(spark):
    """A conversation in a third of all families, and chains that part one turn later each."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 2400) if c % 3 == 0 for t in range(5)]
    rows += [(c, t, "user", f"deep {t if t < c % 40 else (c, t)}") for c in range(2400, 2480) for t in range(45)]
    assert result(op12_conversation_trie(made(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    long = "w " * 100_000
    rows = [(None, 0, "user", "x"), (5, None, None, None), (5, 0, "user", long), (5, 1, "user", "z"), (5, 2, "user", "z"), (5, 3, "u", "z"), (7, 7, "user", "one"), (27, 0, "a", "b"), (27, 1, "a", "b"), (27, 2, "a", "b")]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, node_key binary")
    assert result(op12_conversation_trie(df)) == brute(rows)
    assert op12_conversation_trie(df.limit(0)).collect() == [] and prefix_trie(df.filter("conv_id IS NULL")).collect() == []


def test_turns_of_one_number_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in "abcdef"] + [(2, 1, "user", t) for t in "fedcba"]
    got = [sorted((r.depth, r.n_convs, r.node_key) for r in prefix_trie(made(spark, rows[::s])).collect()) for s in (1, -1)]
    assert got[0] == got[1]


def test_sql_on_odd_rows(spark, tmp_path):
    rows = [(c, t % 4, None if t == 2 else "user", ["a b", "", "c"][(c // 7 + t) % 3]) for c in range(-30, 130, 7) for t in range(c % 6 + 1) if t < 4]
    con = connected("/root/testdata/sf0.001")
    frame = made(spark, rows).toPandas()
    con.register("odd", frame)
    same(op12_conversation_trie(made(spark, rows)), con, OP12_SQL.replace("FROM conversations", "FROM odd"))

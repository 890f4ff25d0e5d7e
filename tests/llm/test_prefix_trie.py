"""The prefix trie against SQL on the given tables and against plain dictionaries on made conversations."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from keepsake.compare import compare, oracle
from keepsake.llm import prefix_trie as T
from keepsake.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, hosts=20, heads=4):
    def name(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, name(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt, members, below = {}, collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        rest = c % hosts if c >= 0 else -(-c % hosts)
        rebuilt[c] = convs.get(c - rest, [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in below[p])
    ends = {p: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p],
                    hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=str)


def made(seed, n, kinds, longest):
    r = random.Random(seed)
    texts = ["a", "b b", "", None, "c  c\tc", "é 漢字"][:kinds]
    return [(c if r.random() > 0.02 else None, r.choice([t, t, t, t, None]),
             r.choice(["user", "assistant", None]) if r.random() < 0.2 else "u", r.choice(texts))
            for c in range(n) if r.random() > 0.1 for t in range(r.randint(1, longest))]


def trie(spark, rows, schema=SCHEMA, **how):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in T.prefix_trie(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed,n,kinds,longest,how", [
    (1, 60, 3, 9, {}),
    (2, 150, 5, 9, {"block": 7, "fan": 2}),                     # forests merged in several rounds
    (3, 90, 1, 14, {"block": 5, "fan": 2, "segment": 4}),       # levels: many share more than a segment
    (4, 80, 6, 5, {"hosts": 7, "heads": 3}),
])
def test_made_conversations(spark, seed, n, kinds, longest, how):
    rows = made(seed, n, kinds, longest)
    own = {k: v for k, v in how.items() if k in ("hosts", "heads")}
    assert trie(spark, rows, **how) == plain(rows, **own)


def test_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op13_prefix_trie(spark, folder)
    assert compare(got.schema, got.collect(), oracle(folder).execute(queries.OP13_SQL)) is None


def test_copies_and_a_common_first_turn(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 2000, 20) for t in range(5)]             # copies
    rows += [(c, t, "u", "hello there" if t == 0 else f"own {c} {t}") for c in range(2000, 5000, 20) for t in range(3)]
    got = trie(spark, rows, block=16, fan=3)
    assert got == plain(rows)
    assert max(r[3] for r in got if r[1] == 5) == 100


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "u", f"w{t} x") for c in (0, 20, 40) for t in range(9000 - 7 * (c == 40))]
    got = trie(spark, rows)
    assert len(got) == 9001 and [r[3] for r in got if r[1] == 9000] == [2] and [r[3] for r in got if r[1] == 8993] == [3]
    assert [r[6] for r in got if r[1] == 0] == [2 * (2 * 8993 + 7)]


def test_odd_rows(spark):
    schema = SCHEMA + ", depth long, seq string, n int, `unit` long"
    rows = [(None, 0, "u", "x"), (-3, None, None, None), (-3, None, None, None), (0, 5, "u", "y" * 200_000), (1, 0, "u", ""),
            (7, 0, "u", "only"), (7, 0, "u", "only"), (21, 1, "a", "z"), (2 ** 62, 0, "u", "big id")]
    assert trie(spark, [r + (9, "s", 1, None) for r in rows], schema) == plain(rows)
    assert trie(spark, [], SCHEMA) == []


def test_branching_nodes_of_one_block():
    """Depth 2 is shared by three sequences, one of which ends there; an item may be a copy group."""
    import numpy as np

    a, b, c = (bytes([x]) * T.NAME for x in (1, 2, 3))

    def item(names, unit, copies=1):
        n = len(names) // T.NAME
        return T.Item(b"", names, np.arange(n + 1) * 10, copies, unit, unit, True, n, n * 10)

    forest = T.Forest(0, 1)
    items = [item(a + b, 5), item(a + b + c, 1, 4), item(a + b + b, 3), item(c, 2)]
    assert forest.contract(items, ()) == []
    nodes = {n[2]: n for n in forest.nodes}
    assert nodes[0][5:9] == (7, 2, 3, 30 + 50 + 50) and nodes[2][1:3] == (1, 2) and nodes[2][5:] == (6, 2, 2, 30 + 50, 5)
    assert sorted(forest.chains) == [(1, 3, 1, None), (2, 1, 1, None), (3, 3, 1, None)]

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sparkloom.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """Every prefix as a tuple, subtrees walked from below."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        saved[p] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in sorted(m for m in members[p] if len(convs[m]) == len(p)))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def rows_of(df):
    assert df.columns == COLUMNS and all(t in ("bigint", "string") for _, t in df.dtypes)
    return sorted(map(tuple, df.collect()))


def made(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_table_equals_the_walk(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    convs = ordered([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert rows_of(prefixtrie.spliced_trie(table)) == plain(rebuilt(convs))
    assert rows_of(prefixtrie.prefix_trie(table)) == plain(convs)


@pytest.mark.parametrize("width, run, together", [(8, 64, 4096), (2, 3, 4), (3, 2, 2)])
def test_random_conversations(spark, monkeypatch, width, run, together):
    monkeypatch.setattr(prefixtrie, "RUN", run)
    monkeypatch.setattr(prefixtrie, "TOGETHER", together)
    monkeypatch.setattr(prefixtrie, "SPAN", 8)
    rnd = random.Random(width)
    rows = []
    for c in [*range(-130, 260, 3), *range(0, 300, 100), 10**15, 10**15 + 100]:
        n = rnd.choice([1, 2, 3, 5, 8, 9, 16, 40])
        common = rnd.choice([0, 1, 6, n, n])
        rows += [(c, t, "u", "same" * (t % 3) if t < common else rnd.choice("ab")) for t in range(n)]
    convs = ordered(rows)
    assert rows_of(prefixtrie.spliced_trie(made(spark, rows).repartition(5), width)) == plain(rebuilt(convs))
    assert rows_of(prefixtrie.prefix_trie(made(spark, rows), width)) == plain(convs)


def test_odd_rows(spark):
    rows = [(1, None, "a", "x"), (1, 0, "b", "y"), (2, None, "a", "x"), (2, 5, None, None), (2, 5, "", ""), (3, 1, "a", "x"), (3, 1, "a", "x"), (None, 0, "a", "x"), (None, 1, "a", "x"), (4, 0, "ab", "c"), (5, 0, "a", "bc"), (6, 0, "", "é😀" * 3000), (7, 0, "", "é😀" * 3000)]
    convs = ordered(rows)
    table = made(spark, rows).selectExpr("*", "1 as pos", "2 as n", "3 as key", "4 as depth")
    assert rows_of(prefixtrie.prefix_trie(table)) == plain(convs)
    assert rows_of(prefixtrie.spliced_trie(table)) == plain(rebuilt(convs))
    assert rows_of(prefixtrie.prefix_trie(made(spark, []))) == [] and rows_of(prefixtrie.spliced_trie(made(spark, []))) == []


def test_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "u", f"t{t}") for t in range(700)] + [(c, t, "u", f"t{t}") for c in (8, 9) for t in range(650)]
    rows += [(c, t, "u", f"s{t}") for c in range(1000, 1400) for t in range(3)]
    convs = ordered(rows)
    assert rows_of(prefixtrie.prefix_trie(made(spark, rows))) == plain(convs)
    assert rows_of(prefixtrie.spliced_trie(made(spark, rows))) == plain(rebuilt(convs))


def test_parents_with_very_many_children(spark):
    """Sent to all tasks or joined: the same parents."""
    rows = [("r", None, 1, 40), *[(f"c{i}", "r", 100 + i, 0) for i in range(39)], ("d", "r", 1, 3), *[(f"e{i}", "d", 200 + i, 0) for i in range(3)]]
    nodes = spark.createDataFrame(rows, "node string, parent string, conv_id long, n_children long")
    both = [sorted((r.node, r.parent_conv_id) for r in prefixtrie._with_parents(nodes, nodes, share).collect()) for share in (2, 10**6)]
    assert both[0] == both[1] == sorted((n, {None: None, "r": 1, "d": 1}[p]) for n, p, _, _ in rows)

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwire.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, bucket string, pos int, depth string"


def order(row):
    """Turn, null first, then the hash of role and text."""
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role.encode())} {role}{text}".encode()).digest())


def rebuilt(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute_force(rows):
    members = defaultdict(list)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns) == d))
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[x] for x in children[path])
        leaves[path] = sum(leaves[x] for x in children[path]) or 1

    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c, end in who if end)))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((min(who)[0], len(path), parent, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    turns = prefix_trie.encoded(spark.createDataFrame(rows, SCHEMA).repartition(3))
    conv = F.col("conv_id")
    sequences = prefix_trie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4)
    nodes = prefix_trie.trie(sequences, turns.select("conv_id").distinct(), **options)
    assert nodes.schema.simpleString() == "struct<" + prefix_trie.NODE.replace(", ", ",").replace(" ", ":").replace(":long", ":bigint") + ">"
    return sorted(map(tuple, nodes.collect()), key=str)


def made_up():
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(90), 1205, 1210, -7, -20, -21]:
        for turn in range(rng.integers(1, 7)):
            rows.append((c, turn * 3 - 2, ("user", "assistant", None, "")[turn % 4], ("a  b c", "d\te", "", None, "x" * 40)[rng.integers(0, 1 + min(c % 7, 4))]))
    for c in range(100, 150):  # copies
        rows += [(c, t, "user", f"the same words {t}") for t in range(5)]
    rows += [(200, t, "user", f"the same words {t}") for t in range(900)]  # a long one
    rows += [(201, t, "user", f"the same words {t}" if t < 850 else "other") for t in range(900)]
    rows += [(300, None, "user", "no number"), (300, None, "user", "none either"), (300, 0, "user", "zero"), (300, 0, "user", "zero"), (300, -5, None, "before")]
    rows += [(None, 1, "user", "no id"), (320, 2**62, "user", "late"), (320, -(2**62), "user", "early"), (341, 1, "us", "er x"), (342, 1, "user", " x")]
    return [(*r, "k", 9, "z") for r in rows]


@pytest.mark.parametrize("local", [20_000, 300, 1])
def test_against_a_plain_trie(spark, local):
    rows = made_up() if local > 1 else [r for r in made_up() if r[0] is None or not 200 <= r[0] <= 201]
    assert found(spark, rows, local=local) == brute_force(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # 4 has no conversation 0 to borrow from, and no more turns than it would borrow.
    few = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(few, t, "user", "a", "", 0, "") for t in range(2)]
    (root,) = found(spark, rows)
    assert root == (few, 0, None, 1, 0, 1, 0, hashlib.sha256(str(few).encode()).hexdigest())


def test_empty_table(spark):
    assert found(spark, []) == []


def test_hash_of_many_ends_in_small_pieces(spark, monkeypatch):
    ids = [(b, i) for b in ("p", "q") for i in [*range(-40, 3000, 7), 10**12]]
    hashes = dict(map(tuple, prefix_trie.ends_hash(spark.createDataFrame(ids, "bucket string, conv_id long").repartition(5)).collect()))
    want = hashlib.sha256(",".join(str(i) for _, i in ids[: len(ids) // 2]).encode()).hexdigest()
    assert hashes == {"p": want, "q": want}


def test_finish_orders_ties_and_ends():
    nodes = prefix_trie.finish([[1, 2], [1, 2], [1], [], [0]], [[3, 4], [3, 4], [3], [], [9]], [2, 3, 5, 7, 8], 4, 1, 6)
    rows = {tuple(n[:7]) for n in nodes}
    assert rows == {(2, 4, 1, 5, 2, 2, 4 * 6 + 2 * 3 + 4), (2, 5, 2, 3, 1, 1, 2 * 3 + 4), (2, 6, 2, 2, 0, 1, 4), (8, 5, 2, 1, 0, 1, 0)}

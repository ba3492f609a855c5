import hashlib
import random
import re
import zlib

import pytest

from featspan.llm.turn_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain_nodes(rows):
    """The nodes by the contract, from dictionaries of prefixes."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(said)] for c, said in own.items()}
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + said[h:]
    members, children, ends = {}, {}, {}
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            p = tuple(said[:d])
            members.setdefault(p, set()).add(c)
            if d:
                children.setdefault(p[:-1], set()).add(p)
        ends.setdefault(tuple(said), set()).add(c)

    def words(p):
        return len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0

    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        out.append(
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())),
                sum(q not in children for q in under), sum((len(members[q]) - 1) * words(q) for q in under),
                hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, 90):
        if rng.random() < 0.15:
            continue
        copied = rng.random() < 0.4  # these are all equal
        for t in range(12 if copied else rng.randrange(1, 7)):
            text = f"same turn {t}" if copied or rng.random() < 0.4 else rng.choice(["", None, "a b", "x\ty", "a b c"])
            rows.append((c, t, rng.choice(["user", None]) if not copied else "user", text, "x"))
    rows += [(7, None, "user", "first of all", "x"), (7, 0, "user", "tie", "x"), (7, 0, "user", "tie", "x"), (None, 0, "user", "no one's", "x")]
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20, 4096])
def test_nodes_equal_plain_prefixes(spark, limit):
    rows = conversations(limit)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_nodes(rows)


def test_heads_deeper_than_one_pass(spark):
    rows = [(20 * c, t, "user", f"turn {t}" if t < 30 else f"end {c}", "") for c in range(12) for t in range(32)]
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA), limit=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_nodes(rows)


def test_no_conversations(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x", "")], SCHEMA)).count() == 0

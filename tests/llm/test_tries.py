"""The prefix trie against a plain version and its SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from conftest import DATA

from posora.llm import prefix_trie as tries
from posora.llm.queries import ORACLE_SQL, QUERIES
from posora.llm.shared import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, id long, at int, n int, rep string, up string, part int"


def plain(seqs):
    """Nodes of {conv: [(role, text)]}."""
    members, ends = {}, {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = set()
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        parents = {x[:-1] for x in members if x}
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), sum(x[:-1] == node for x in members if x), sum(x not in parents for x in below), saved, digest))
    return out


def taken(df):
    rows = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(rng, n, longest, kinds):
    """Rows and their sequences; many share beginnings, some are copies, some are long."""
    rows, seqs, made = [], {}, []
    for c in rng.sample(range(-40, 5000), n):
        turns = list(rng.choice(made)) if made and rng.random() < 0.5 else []
        turns = turns[: rng.randint(0, len(turns))] if rng.random() < 0.7 else turns
        turns += [(rng.choice(["user", "assistant"]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, kinds)))) for _ in range(rng.randint(0, longest) if rng.random() < 0.9 else 3 * longest)]
        turns = turns or [("user", "a")]
        made.append(turns)
        seqs[c] = turns
        rows += [(c, i * 2 if i else None, r or None, t or None, 1, 2, 3, "x", "y", 4) for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows, seqs


@pytest.mark.parametrize(("seed", "block", "parts"), [(1, 128, 4), (2, 3, 7), (3, 2, 5), (4, 1, 3)])
def test_trie_equals_plain_version(spark, seed, block, parts):
    rng = random.Random(seed)
    rows, seqs = conversations(rng, 60, 5, 2)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scratch = Scratch(spark)
        digests = tries.turn_digests(spark.createDataFrame(rows, SCHEMA))
        assert taken(tries.prefix_trie(*tries.as_they_are(digests, scratch), scratch, block)) == plain(seqs)
        rebuilt = {}
        for c in seqs:
            # remainders have the sign of the dividend, as in SQL
            h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
            rebuilt[c] = seqs.get(base, [])[:h] + seqs[c][h:]
        assert taken(tries.prefix_trie(*tries.rebuilt(digests, scratch), scratch, block)) == plain(rebuilt)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_tables(spark):
    scratch = Scratch(spark)

    def run(rows):
        return taken(tries.prefix_trie(*tries.rebuilt(tries.turn_digests(spark.createDataFrame(rows, SCHEMA)), scratch), scratch, 4))

    assert run([]) == set()
    assert run([(None, 1, "user", "a", *[None] * 6)]) == set()
    blank = (1, 2, 3, "x", "y", 4)
    # conversation 3 takes nothing from the absent 0 and loses its first turns: all that is left is the root
    empty = hashlib.sha256(b"3").hexdigest()
    h = zlib.crc32(b"3") % 4
    assert h and run([(3, 0, "user", "a", *blank)]) == {(3, 0, None, 1, 0, 1, 0, empty)}
    # repeated rows are turns of their own; ties and nulls in the turn, a long text
    rows = [(20, 5, "user", "w " * 5000, *blank)] * 9 + [(20, None, None, None, *blank)] * 2 + [(40, t, "user", "b", *blank) for t in (7, 7, 7)]
    turns = {20: [("", "")] * 2 + [("user", "w " * 5000)] * 9, 40: [("user", "b")] * 3}
    assert run(rows) == plain(turns)


def test_copies_become_one_entry_and_long_conversations_many(spark):
    rows = [(20 * c, t, "user", f"t{t}", 1, 2, 3, "x", "y", 4) for c in range(3000) for t in range(3)] + [(7, t, "user", f"l{t}", 1, 2, 3, "x", "y", 4) for t in range(2000)]
    scratch = Scratch(spark)
    out = tries.prefix_trie(*tries.as_they_are(tries.turn_digests(spark.createDataFrame(rows, SCHEMA)), scratch), scratch, 64)
    found = {(r.conv_id, r.depth): r for r in out.collect()}
    assert len(found) == 1 + 3 + 2000
    assert found[(0, 3)].n_convs == 3000 and found[(0, 1)].saved_tokens == 3 * 2999 and found[(7, 2000)].ends_sha256 == hashlib.sha256(b"7").hexdigest()
    assert found[(0, 0)].n_leaves == 2 and found[(0, 0)].n_children == 2
    assert found[(0, 3)].ends_sha256 == hashlib.sha256(",".join(str(20 * c) for c in range(3000)).encode()).hexdigest()


def test_query_equals_its_sql(spark):
    sf = f"{DATA}/sf0.01"
    df = QUERIES["op11_prefix_trie"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    found = con.execute(ORACLE_SQL["op11_prefix_trie"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)

"""The prefix trie against a dictionary of all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from splitlane.llm import oracle, prefix_trie
from splitlane.llm.prefix_trie import end_digests, paths, splitters
from splitlane.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, path string, chars long, pid string, skeleton int"


def brute(convs):
    """Rows of all nodes of ``{conv_id: [(role, text), ...]}``."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
        nodes[tuple(turns)]["ends"].append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        saved[key] = sum(saved[k] for k in below)
        if key:
            saved[key] += (len(nodes[key]["members"]) - 1) * len(key[-1][1])
    return sorted(
        (
            min(node["members"]),
            len(key),
            min(nodes[key[:-1]]["members"]) if key else None,
            len(node["members"]),
            len(kids.get(key, [])),
            leaves[key],
            saved[key],
            hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest(),
        )
        for key, node in nodes.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def as_turns(convs):
    return [(c, i, r, t, "p", 1, "x", 2) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


def many(rng, n):
    """Conversations with shared beginnings, copies, and one of many turns."""
    out = {}
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:
            out[c] = [("user", "the same"), ("assistant", "conversation")]
        elif kind < 0.6:
            out[c] = [("user", "the same"), *(("user", rng.choice("abc")) for _ in range(rng.randint(0, 8)))]
        else:
            out[c] = [(rng.choice(["user", "", "bot"]), rng.choice(["", "é", "hello", "a:b"])) for _ in range(rng.randint(1, 5))]
    out[n] = [("user", "the same")] + [("user", "long")] * 300
    out[n + 1] = [("user", "the same")] + [("user", "long")] * 300 + [("user", "x")]
    return out


@pytest.mark.parametrize("shard_turns", [10**9, 40])
def test_all_nodes_whatever_the_shards(spark, shard_turns):
    convs = many(random.Random(4), 400)
    turns = spark.createDataFrame(as_turns(convs), SCHEMA).repartition(5)
    rows = prefix_trie.prefix_trie(paths(turns, "conv_id", "turn", "role", "text"), shard_turns)
    assert got(rows) == brute(convs)


def test_splitters_are_beginnings_of_paths_and_cut_evenly(spark):
    convs = many(random.Random(5), 600)
    turns = spark.createDataFrame(as_turns(convs), SCHEMA)
    distinct = prefix_trie.distinct_paths(paths(turns, "conv_id", "turn", "role", "text")).cache()
    cuts = splitters(distinct, 60)
    every = [bytes(r.path) for r in distinct.select("path").collect()]
    assert len(cuts) > 5 and cuts == sorted(set(cuts))
    assert all(any(p.startswith(cut) for p in every) and len(cut) <= 64 * prefix_trie.NAME for cut in cuts)


def test_digests_of_a_hot_path_are_put_together_from_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 20)
    ids = random.Random(1).sample(range(-500, 5000), 900)
    rows = [(b"hot" if i % 3 else b"%d" % (i % 7), i) for i in ids]
    members = spark.createDataFrame(rows, "pid binary, conv_id long").repartition(4)
    found = {bytes(r.pid): r.ends for r in end_digests(members).collect()}
    wanted = {}
    for p, i in sorted(rows):
        wanted.setdefault(p, []).append(str(i))
    assert found == {p: hashlib.sha256(",".join(v).encode()).hexdigest() for p, v in wanted.items()}


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first: no number", "", 0, "", 0),
        (1, 0, None, None, "", 0, "", 0),
        (1, 1, "", "", "", 0, "", 0),  # equal to the turn before it
        (2, 5, "user", "first: no number", "", 0, "", 0),
        (None, 0, "user", "belongs to none", "", 0, "", 0),
        (3, 0, "us", "er", "", 0, "", 0),
        (4, 0, "use", "r", "", 0, "", 0),
        (5, 0, "user", "x" * 2_000_000, "", 0, "", 0),
    ]
    convs = {
        1: [("user", "first: no number"), ("", ""), ("", "")],
        2: [("user", "first: no number")],
        3: [("us", "er")],
        4: [("use", "r")],
        5: [("user", "x" * 2_000_000)],
    }
    turns = spark.createDataFrame(rows, SCHEMA)
    assert got(prefix_trie.prefix_trie(paths(turns, "conv_id", "turn", "role", "text"))) == brute(convs)
    again = [(1, 0, "a", "b", "", 0, "", 0)] * 2  # one turn twice is two turns
    turns = spark.createDataFrame(again, SCHEMA)
    assert got(prefix_trie.prefix_trie(paths(turns, "conv_id", "turn", "role", "text"))) == brute({1: [("a", "b")] * 2})
    empty = spark.createDataFrame([], SCHEMA)
    assert got(prefix_trie.prefix_trie(paths(empty, "conv_id", "turn", "role", "text"))) == []
    turnless = spark.createDataFrame([(7, []), (8, [])], paths(empty, "conv_id", "turn", "role", "text").schema)
    assert got(prefix_trie.prefix_trie(turnless)) == brute({7: [], 8: []})


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(6)
    small = {c: [("u", rng.choice("ab"))] * rng.randint(1, 7) for c in [0, 1, 5, 105, 300, 301, 399, 777]}
    rows = [r[:4] for r in as_turns(small)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet")
    )
    for folder, files in ((SF, f"{SF}/conversations.parquet"), (str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet")):
        found = got(QUERIES["op13_prefix_trie"].run(spark, folder))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{files}'")
        table = con.execute("SELECT conv_id, turn, coalesce(role, ''), coalesce(text, '') FROM conversations").fetchall()
        convs = {}
        for c, _, r, t in sorted(table):
            convs.setdefault(c, []).append((r, t))
        assert found == brute(rebuilt(convs))
        sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle.TRIE})").fetchall()
        assert sorted(sql) == found

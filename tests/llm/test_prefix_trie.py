"""The trie of rebuilt conversations against a trie of Python dictionaries."""

import hashlib
import math
import random
import zlib

import pytest

from tidewatch.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos string, `n.a` string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: own.get(c - int(math.fmod(c, 5)), [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def sub(path):
        below = [sub(k) for k in kids.get(path, [])]
        own_saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        return (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))

    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])), *sub(path), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    found = p.prefix_trie(spark.createDataFrame([(*r, "d", "p", "n") for r in rows], SCHEMA))
    assert sorted((tuple(r) for r in found.select(*OUT).collect()), key=repr) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(40), 100, 1003, 77_777]:
        n = rng.choice([1, 2, 3, 5, 9, 12])
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "yes", "é ü", "", None])) for t in range(n)]
    check(spark, rows)


def test_copies_chains_nulls_and_long_ones(spark):
    # Ids that end in 0 or 5 keep their own turns; a third of all turns is one conversation's.
    base = [(0, t, "user", f"q{t}") for t in range(30)]
    copies = [(c, t, "user", f"q{t}") for c in range(5, 60, 5) for t in range(30)]
    near = [(100, t, "user", f"q{t}" if t < 29 else "other") for t in range(30)]
    long = [(205, t, "a", "same") for t in range(400)]
    odd = [(None, 1, "user", "lost"), (300, None, None, None), (300, None, None, None), (300, 1, "ab", "c"), (305, None, "a", "bc"), (-3, 0, "u", "neg"), (-5, 0, "u", "neg"), (1, 3, "u", "x")]
    check(spark, base + copies + near + long + odd)


def test_one_conversation_and_none(spark):
    check(spark, [(7, 1, "u", "x")])
    check(spark, [(10, t, "u", "x") for t in range(3)])
    empty = spark.createDataFrame([], SCHEMA)
    assert p.prefix_trie(empty).collect() == []
    assert p.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", "", "", "")], SCHEMA)).columns == OUT


@pytest.mark.parametrize("piece", [1, 2, 5000])
def test_members_are_hashed_in_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(p, "PIECE", piece)
    rows = spark.createDataFrame([(i % 3 % 2, i) for i in range(-5, 200)], "k long, conv long").repartition(7)
    got = {r.k: r.ends for r in p.member_digests(rows, ["k"]).collect()}
    want = {k: ",".join(str(i) for i in range(-5, 200) if i % 3 % 2 == k) for k in (0, 1)}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in p.op12_prefix_trie(spark, sf).select(*OUT).collect()), key=repr) == plain(rows)

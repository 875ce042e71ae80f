"""Prefix trie of rebuilt conversations against dictionaries of whole prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tripweave.llm import conversations
from tripweave.llm.queries import QUERIES


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, held in members.items():
        ended = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def found(turns):
    conv = F.col("conv")
    table = conversations.trie(*conversations.spliced(conversations.ordered(turns), conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5))
    return sorted(map(tuple, table.collect()), key=str)


DDL = "conv_id bigint, turn bigint, role string, text string, depth int, name string, conv int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DDL).repartition(5)


def test_whole_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str) == plain(rows)


def test_nulls_ties_repeats_and_shared_prefixes(spark):
    rows = [(None, 1, "user", "lost"), (None, None, None, None)]
    for c in (*range(100, 130), *range(195, 205), -7, -100, 7):
        for turn in range(c % 9):
            rows.append((c, turn if turn != 2 else None, "user" if turn % 2 else None, f"é text {turn}" if turn % 3 else None))
    rows += [(101, 3, "a", "tie"), (101, 3, "a", "also"), (101, 3, "a", "tie"), (300, None, None, None), (305, 1, "user", "own \U0001f600")]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1060) for t in range(7)]
    assert found(frame(spark, rows)) == plain(rows)


@pytest.mark.parametrize("turns", [1, 2, 3, 64, 65])
def test_heights(spark, turns):
    """One long conversation, a copy of it, and one that leaves it at every depth of a power of two."""
    rows = [(0, t, "user", f"t{t}") for t in range(turns)] + [(100, t, "user", f"t{t}") for t in range(turns)]
    for k in range(7):
        rows += [(1000 + 100 * k, t, "user", f"t{t}" if t < 1 << k else f"other {k} {t}") for t in range(turns)]
    assert found(frame(spark, rows)) == plain(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "user", "a") for c in (301, 302, 303, 304, 305)]
    lost = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6]
    assert lost and found(frame(spark, lost)) == plain(lost)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, 1, "user", "a")])) == []


def test_a_conversation_over_many_ranges(spark):
    rows = [(0, t, "user", f"t{t % 10}") for t in range(600)] + [(100, t, "user", f"t{t % 10}") for t in range(500)] + [(200, 0, "user", "x")]
    assert found(frame(spark, rows)) == plain(rows)

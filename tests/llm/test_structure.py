"""Conversation repair against dynamic programming over the audits themselves."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from urlsieve.llm import structure

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, turns left) of rows (initial, must go, truncated, role, text), over states '', s, u, a."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        grown = True
        while grown:
            grown = False
            for state, (cost, audit, out) in list(best.items()):
                to = after[state]
                new = (cost + 2, audit + "I", [*out, f"{name[to]}:"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to], grown = new, True
        return best

    best = {"": (0, "", [])}
    for initial, gone, cut, role, text in rows:
        new = {}

        def offer(state, item, new=new):
            if state not in new or item[:2] < new[state][:2]:
                new[state] = item

        for state, (cost, audit, out) in inserted(best).items():
            offer(state, (cost + 3, audit + "D", out))
            if not gone:
                to = after[state]
                offer(to, (cost + 2 + cut, audit + "R", [*out, f"{name[to]}:{text}"]))
                if initial == to or initial == "s" and state == "":
                    offer(initial, (cost + cut, audit + "K", [*out, f"{role}:{text}"]))
        best = new
    ends = [x for s, x in inserted(best).items() if s in ("", "a")]
    return min(ends, key=lambda x: x[:2])


def brute(turns):
    """Rows by conversation: what the query returns."""
    held = {}
    for conv, turn, role, text in turns:
        rows = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        rows += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = cheapest(marked)
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(n: int, long: int, seed: int = 5):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Perhaps", "Why?  ", "", "  \n", "a.b", None, "é…", "Good.\x1f", "x. \t"]
    roles = ["user", "assistant", "system", "tool", "User", None, "", "s"]
    out = []
    for conv in range(n):
        size = long if conv == 0 else rng.randrange(1, 14)
        for turn in range(size):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.7 else rng.choice(roles)
            text = f"{rng.randrange(10**6)}." if rng.random() < 0.6 else rng.choice(texts)
            out.append((conv, None if rng.random() < 0.03 else turn // rng.choice([1, 1, 1, 2]), role, text))
    return out + [(None, None, None, None), (None, 3, "user", "Hello."), (10**9, None, "user", "Hi."), (10**9, None, "user", "Hi.")]


@pytest.mark.parametrize("run", [3, structure.RUN])
def test_rows_equal_brute_force(spark, run):
    turns = conversations(120, 500)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    rows = structure.digests(structure.repair(structure.damage(df), run)).collect()
    want = {c: x for c, x in brute(turns).items() if x[6]}
    assert {r.conv_id: tuple(r)[1:] for r in rows} == want


def test_query_returns_all_conversations(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = [*conversations(30, 20), (5000 + gone, 0, "user", "Hi.")]
    while zlib.crc32(f"{turns[-1][0]}:0".encode()) % 20:
        turns[-1] = (turns[-1][0] + 1, 0, "user", "Hi.")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = {r.conv_id: tuple(r)[1:] for r in structure.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert rows == brute(turns)
    assert rows[turns[-1][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_products_associate_and_rank_like_audits():
    rng = np.random.default_rng(2)
    for size in (1, 2, 5, 33):
        kinds = rng.integers(0, 12, size)
        whole = structure.Tree(structure.EDITS.cost[kinds], structure.EDITS.rank[kinds], np.zeros(size, int))
        for cut in {1, size // 2, size - 1} - {0, size}:
            parts = [structure.Tree(structure.EDITS.cost[k], structure.EDITS.rank[k], np.zeros(len(k), int)) for k in (kinds[:cut], kinds[cut:])]
            both = structure.Tree(np.concatenate([p.cost for p in parts]), np.concatenate([p.rank for p in parts]), np.zeros(2, int))
            assert (both.cost == whole.cost).all()
            assert (both.rank[whole.cost < structure.FAR] == whole.rank[whole.cost < structure.FAR]).all()


def test_rows_of_the_operator(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "tool", "Found."), (1, 2, "assistant", "Yes"), (1, 3, "assistant", "Yes"), (1, 4, "user", " ")]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").withColumn("run_", structure.F.lit(1))
    rows = structure.repair(df).orderBy("run", "place").collect()
    assert [(r.fault, r.inserted, r.edit, r.new_role, r.closing) for r in rows] == [(None, "", "K", "", ""), (None, "", "R", "user", ""), ("truncated", "", "K", "", ""), ("duplicate", "", "D", "", ""), ("blank", "", "D", "", "")]
    assert {r.cost for r in rows} == {2 + 1 + 3 + 3}
    assert structure.repair(df.limit(0)).collect() == []
    assert structure.digests(structure.repair(df.limit(0))).collect() == []


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    turns = conversations(40, 60)
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert {r[0]: r[1:] for r in con.sql(structure.SQL).fetchall()} == brute(turns)

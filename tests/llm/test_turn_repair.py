"""Conversation repair against enumeration of all edits, and against a plain version of the whole operator."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import turn_repair as T
from palisade.sources.tables import table

GOOD = re.compile("(s?(ua)+)?")
START = re.compile("s?(ua)*u?$")


def enumerated(rows):
    """Cheapest (cost, audit) and the lines of it, over all edits with at most two insertions a gap."""
    best = None

    def go(i, roles, audit, cost, lines):
        nonlocal best
        for extra in ("", "u", "a", "ua", "au"):
            r, c, a = roles + extra, cost + 5 * len(extra), audit + "I" * len(extra)
            if (best is not None and c > best[0]) or not START.match(r):
                continue
            out = lines + [f"{T.NAMES[x]}:" for x in extra]
            if i == len(rows):
                if GOOD.fullmatch(r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, out)
                continue
            role, text, fault = rows[i]
            go(i + 1, r, a + "D", c + 2, out)
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                go(i + 1, r + (role[:1] or "-"), a + "K", c + stays, [*out, f"{role}:{text}"])
                for x, name in T.NAMES.items():
                    go(i + 1, r + x, a + "R", c + stays + 1, [*out, f"{name}:{text}"])

    go(0, "", "", 0, [])
    return best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def plain(rows):
    """conv_id -> result of repair_damaged, conversation by conversation in memory."""
    by_id = {}
    for conv_id, turn, role, text in rows:
        held = by_id.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        held += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = {}
    for conv_id, held in by_id.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in held:
            solid = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in held if t is not None]
        initials = [r[:1] for _, r, _ in held]
        cost, audit, sha = T.repair([(*r, 1) for r in faulty])
        n = lambda f: sum(x[2] == f for x in faulty)
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n("blank"), n("duplicate"), n("truncated"),
                        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def result(frame):
    rows = frame.collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_parser_takes_the_cheapest_edits():
    random.seed(5)
    roles, faults = ["user", "assistant", "system", "user", "assistant", "tool", ""], ["", "", "", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        rows = [(random.choice(roles), random.choice(["a.", "b!", ""]), random.choice(faults)) for _ in range(random.randrange(7))]
        assert T.repair([(*r, 1) for r in rows]) == enumerated(rows), rows


def test_runs_of_copies_are_parsed_as_their_rows():
    random.seed(6)
    for _ in range(500):
        rows = [(random.choice(["user", "assistant", "system"]), "x", random.choice(["", "blank", "truncated"]), random.randrange(1, 4)) for _ in range(5)]
        rows = [(r, t, f, n if f == "blank" else 1) for r, t, f, n in rows]
        assert T.repair(rows) == T.repair([(r, t, f, 1) for r, t, f, n in rows for _ in range(n)])


def test_the_table_refuses_a_grammar_with_a_choice():
    with pytest.raises(ValueError):
        T.slr_table((("S", ("D",)), ("S", ("E",)), ("D", ("u",)), ("E", ("u",))))


@pytest.mark.parametrize("per_range", [7, 10_000])
def test_hot_conversations_ties_and_nulls(spark, per_range):
    random.seed(7)
    texts = ["Yes.", "No", "", " \t", "What?", "Yes. ", "é", "ok\nthen!", None]
    rows = [(None, t, random.choice(["user", "assistant"]), random.choice(texts)) for t in [None, None, 3, 3, 9]]
    rows += [(1, t, random.choice(["system", "user", "assistant", None]), f"{random.choice(texts)}{t % 40}.") for t in range(300)]
    rows += [(2, 5, "user", "same.")] * 60 + [(2, 6, "user", "")] * 30 + [(2, 5, "assistant", "same.")] * 3
    rows += [(c, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], random.choice(texts) or "") for c in range(10, 60) for t in range(c % 6)]
    rows += [(3, None, None, None), (4, 1, "user", "x" * 50_000 + "."), (5, 2, "", "no role."), (6, 2, "Useful", "other.")]
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    frame = frame.select("*", F.lit(1).alias("count"), F.lit("x").alias("audit"), F.lit(0).alias("part"))
    assert result(T.repair_damaged(frame, per_range)) == plain(rows)


def test_conversations_without_rows_left_and_empty_tables(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert result(T.repair_damaged(frame)) == {gone: (0, 0, 0, 0, 0, 0, "", T.NO_TEXT)}
    assert T.repair_damaged(frame.limit(0)).collect() == []


def test_as_they_stand_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 4, "assistant", "More")]
    found = result(T.repair_conversations(spark.createDataFrame(rows, SCHEMA)))
    assert found == {1: (1, 0, 1, 1, 2, 4, "KDKD", hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest())}


def test_query_equals_the_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    from palisade.llm.queries import JOBS

    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table(spark, folder, "conversations").collect()]
    assert result(JOBS["op12_conversation_repair"](spark, folder)) == plain(rows)

"""Conversation repair against all edits of short conversations, and its edges."""

import hashlib
import itertools
import random
import re

from paperloom.llm import chat_repair

WORDS = "yes no sure well then so".split()


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        told = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "" if told[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit of every row and up to two insertions in every gap."""
    found = faults(rows)
    choices = []
    for (role, text), fault in zip(rows, found):
        own = [("D", 2, None)]
        if fault in ("", "truncated"):
            more = 5 * (fault == "truncated")
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(own)
    added = [()] + [x for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None
    for gaps in itertools.product(added, repeat=len(rows) + 1):
        if sum(map(len, gaps)) > 2:
            continue
        for edits in itertools.product(*choices):
            cost, audit, out = 5 * sum(map(len, gaps)) + sum(e[1] for e in edits), "", []
            for gap, edit in zip(gaps, [*edits, None]):
                audit += "I" * len(gap)
                out += [(role, "") for role in gap]
                if edit:
                    audit += edit[0]
                    out += [edit[2]] if edit[2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def report(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, step string")
    edits = chat_repair.repair_conversations(frame)
    return edits, {x["conv_id"]: x for x in chat_repair.repair_report(edits).collect()}


def test_repair_is_the_cheapest_of_all_edits(spark):
    r, rows = random.Random(5), []
    for c in range(60):
        for turn in range(r.randrange(1, 5)):
            role = r.choice(["user", "assistant", "assistant", "user", "system", "tool", ""])
            rows.append((c, turn * r.randrange(1, 3), role, r.choice(["", " \t", "yes.", *(r.choice(WORDS) + r.choice([".", "", "? \n"]) for _ in range(4))]), 1, "x"))
    edits, out = report(spark, rows)
    repaired = {}
    for x in sorted(edits.collect(), key=lambda x: x["place"]):
        repaired.setdefault(x["conv_id"], []).extend([] if x["edit"] == "D" else [(x["role"], x["text"])])
    assert len(out) == len({x[0] for x in rows})
    for c, x in out.items():
        own = [(role, text) for _, role, text in sorted((turn, role, text) for conv, turn, role, text, *_ in rows if conv == c)]
        cost, audit, told = cheapest(own)
        assert (x["cost"], x["audit"], repaired[c]) == (cost, audit, told), own
        found = faults(own)
        assert [x[f] for f in chat_repair.FAULTS] == [found.count(f) for f in chat_repair.FAULTS]
        turns = [turn for conv, turn, *_ in rows if conv == c]
        assert x["gaps"] == max(turns) - min(turns) + 1 - len(set(turns))
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(own, own[1:])]
        assert x["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert x["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in told).encode()).hexdigest()


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, None, "Hi.", 1, "x"), (1, None, "user", None, 1, "x"), (None, 3, "user", "Hm?", 1, "x"), (None, None, "user", "Hm?", 1, "x"), (None, 3, "assistant", "So.", 1, "x")]
    edits, out = report(spark, rows)
    assert (out[1]["gaps"], out[1]["blank"], out[1]["audit"], out[1]["cost"]) == (0, 1, "DD", 4)
    # The row without a turn comes first, so the later one of the same words goes.
    assert (out[None]["audit"], out[None]["duplicate"], out[None]["gaps"]) == ("KKD", 1, 0)
    empty = chat_repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, a int, b string").limit(0))
    assert empty.count() == 0 and chat_repair.repair_report(empty).count() == 0


def test_state_crosses_batches(spark):
    """One conversation of many Arrow batches: user and assistant in turn, one assistant row missing."""
    n = 5000
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"row {i}.", 1, "x") for i in range(n) if i != 3001]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 64)
    try:
        _, out = report(spark, rows)
    finally:
        spark.conf.set(name, before)
    # Deleting one of the two users is cheaper than to insert an answer.
    assert (out[7]["cost"], out[7]["gaps"], out[7]["illegal"]) == (2, 1, 1)
    assert out[7]["audit"] == "K" * 3000 + "D" + "K" * (n - 3002)


def test_damage_by_row_number(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two{t}!") for c in range(30) for t in (*range(4), None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else text.replace(".", "").replace("!", "") if kind == 2 else text
            expected += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, chat_repair.damaged(frame).collect()), key=key) == sorted(expected, key=key)

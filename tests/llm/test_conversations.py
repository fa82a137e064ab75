"""Conversation repair against every way of editing short conversations, and against a plain left-to-right search of long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from plumbline.llm import conversations as C

SOUND = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """blank, duplicate, truncated or None for each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain(rows):
    """Cheapest cost and audit by states, one row after the other; then the texts that they give."""
    best = {"": (0, "")}

    def shut(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return best

    shut(best)
    for (_, role, _), fault in zip(rows, faults(rows), strict=True):
        after = {}

        def offer(state, cost, audit, after=after):
            after[state] = min(after.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            offer(state, cost + 3, audit + "D")
            if fault in ("blank", "duplicate"):
                continue
            more = cost + (fault == "truncated")
            if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                offer(role[:1], more, audit + "K")
            offer("a" if state == "u" else "u", more + 2, audit + "R")
        best = shut(after)
    return min(best[s] for s in ("", "a") if s in best)


def spelled(rows, audit):
    out, rows, last = [], iter(rows), ""
    for letter in audit:
        _, role, text = ("", "", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        out.append((role, text))
    assert next(rows, None) is None and SOUND.match("".join(r[0] for r, _ in out))
    return out


def expected(rows):
    kinds, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit = plain(rows)
    text = "\n".join(f"{r}:{t}" for r, t in spelled(rows, audit))
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(((t, r, x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def test_every_edit_of_short_conversations():
    """All audits of at most two turns, with up to three inserts in each place."""
    for n in range(3):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            for texts in itertools.product(["One.", "Two", " "], repeat=n):
                rows = list(zip(range(n), roles, texts, strict=True))
                kinds, found = faults(rows), []
                for letters in itertools.product("KRD", repeat=n):
                    if any(k in ("blank", "duplicate") and x != "D" for k, x in zip(kinds, letters, strict=True)):
                        continue
                    for gaps in itertools.product(range(4), repeat=n + 1):
                        audit = "".join("I" * g + x for g, x in itertools.zip_longest(gaps, letters, fillvalue=""))
                        # Rewritten and inserted turns take either role.
                        kept = [{"I": "ua", "R": "ua"}.get(x) for x in audit if x != "D"]
                        firsts = iter(r[0] for r, x in zip(roles, letters, strict=True) if x == "K")
                        kept = [k or next(firsts) for k in kept]
                        if any(SOUND.match("".join(p)) for p in itertools.product(*kept)):
                            cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in audit)
                            found.append((cost + sum(k == "truncated" and x != "D" for k, x in zip(kinds, letters, strict=True)), audit))
                m = C.tree(C.run_matrix(r[0], k not in ("blank", "duplicate"), k == "truncated", 1) for (_, r, _), k in zip(rows, kinds, strict=True))
                assert min(filter(None, (m[C.START][C.START], m[C.START][C.ASSISTANT]))) == min(found) == plain(rows)


def test_products_are_associative():
    rng = random.Random(4)
    for _ in range(200):
        a, b, c = (C.run_matrix(rng.choice("suat"), rng.random() < 0.7, rng.random() < 0.4, rng.randrange(1, 4)) for _ in range(3))
        assert C.times(C.times(a, b), c) == C.times(a, C.times(b, c)) and C.times(a, C.ANY) == a == C.times(C.ANY, a)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in [*range(60), None, -3]:
        for turn in range(rng.randrange(1, 10)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2] if turn else rng.choice(["system", "user"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), None if rng.random() < 0.05 else "" if rng.random() < 0.03 else role, rng.choice([None, "", " \t\n", "Yes.", "No", "Why? ", "Sí!\x0b", f"{turn} {conv}."])))
    rows += rows[:20]  # repeated rows
    for turn in range(1500):  # one conversation holds most rows, of which many are alike
        rows.append((7000, turn // 2 if turn % 7 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"{turn}.", f"{turn}", " "])))
    rows.append((9000, next(t for t in range(1000) if zlib.crc32(f"9000:{t}".encode()) % 20 == 0), "user", "Dropped."))
    return rows


def test_tables_against_the_plain_search(spark, talks):
    rng = random.Random(3)
    df = spark.createDataFrame(rng.sample(talks, len(talks)), "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' AS copies", "1 AS part", "2 AS audit", "text AS digest", "3 AS initial")
    got = {r["conv_id"]: r.asDict() for r in C.report(C.damage(df)).collect()}
    by_conv = {c: in_order([r for r in damaged(talks) if r[0] == c]) for c in {r[0] for r in talks}}
    assert got == {c: {"conv_id": c} | expected(rows) for c, rows in by_conv.items()}
    assert got[9000]["audit"] == "" and got[9000]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    found = C.runs(C.damage(df), "copies")
    turns = C.repair(found, C.audit(found)).collect()
    for conv, rows in by_conv.items():
        mine = sorted((t for t in turns if t["conv_id"] == conv), key=lambda t: t["position"])
        assert [(t["role"], t["text"]) for t in mine] == spelled(rows, got[conv]["audit"]) and [t["position"] for t in mine] == list(range(len(mine)))


def test_very_long_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), f"Turn {t}{rng.choice(['.', ''])}") for t in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = C.audit(C.runs(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = expected([r[1:] for r in rows])
    assert len(got) == 1 and {k: got[0][k] for k in want if k != "repaired_sha256"} == {k: v for k, v in want.items() if k != "repaired_sha256"}


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.report(C.damage(df)).count() == 0

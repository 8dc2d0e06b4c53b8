"""Conversation repair against a search over all edits, and blocks against whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from mailsift.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, block int, audit string, seen int, _code int, _times int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def cheapest(initials, faults):
    """Least (cost, audit) by a search over (turns read, last letter), whatever the length of the target."""
    heap, done = [(0, "", 0, "")], set()
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = None
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if best and (cost, audit) >= best:
            break
        if i == len(initials) and last in ("", "a"):
            best = min(best or (cost, audit), (cost, audit))
        if (i, last, cost, audit) in done or len(audit) > 3 * len(initials) + 4:
            continue
        done.add((i, last, cost, audit))
        if cost > 3 * len(initials):
            continue
        heapq.heappush(heap, (cost + 2, audit + "I", i, after[last]))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last))
            if faults[i] not in ("b", "d"):
                cut = faults[i] == "t"
                if initials[i] == after[last] or initials[i] == "s" and last == "":
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, initials[i]))
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, after[last]))
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        t = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{t(conv)}:{t(turn)}".encode()) % 20
        row = (conv, turn, "user" if code == 4 else t(role), "" if code == 1 else re.sub("[.!?]", "", t(text)) if code == 2 else t(text))
        out += [row] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_report(original, now):
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted((r for r in now if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in rows]
        cost, audit = cheapest(initials, faults) if rows else (0, "")
        turns = [r[1] for r in rows if r[1] is not None]
        text, at, last = [], iter(rows), ""
        for edit in audit:
            row = next(at) if edit != "I" else None
            if edit == "D":
                continue
            last = row[2][:1] if edit == "K" else "a" if last == "u" else "u"
            text.append((row[2] if edit == "K" else {"u": "user", "a": "assistant"}[last]) + ":" + (row[3] if row else ""))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert df.columns == cols
    return sorted([tuple(r) for r in df.collect()], key=str)


def script(audit, initials, faults):
    """Cost of an audit and whether its letters fit the grammar, step by step."""
    last, cost, at, letters = "", 0, 0, ""
    for edit in audit:
        if edit != "I":
            bad = faults[at]
            at += 1
        if edit == "D":
            cost += 3
            continue
        assert edit == "I" or bad not in ("b", "d")
        last = initials[at - 1] if edit == "K" else "a" if last == "u" else "u"
        letters += last
        cost += {"K": 0, "R": 2, "I": 2}[edit] + (edit != "I" and bad == "t")
    assert at == len(initials) and re.fullmatch("(s?(ua)+)?", letters)
    return cost


def test_align_as_search():
    rng = random.Random(5)
    for _ in range(600):
        n = rng.randint(0, 7)
        initials = [rng.choice("suuaaax ") for _ in range(n)]
        faults = [rng.choice(["", "", "", "b", "d", "t"]) for _ in range(n)]
        audit, letters, _ = C.align(initials, faults)
        assert (script(audit, initials, faults), audit) == cheapest(initials, faults), (initials, faults)


def chained(initials, faults, size):
    """The blocks of one conversation put together as the Spark jobs do."""
    cuts = [(initials[i:i + size], faults[i:i + size]) for i in range(0, len(initials), size)]
    ahead, known = C.FINAL, []
    for block in reversed(cuts):
        known.append(ahead)
        matrix = C.between(*block)
        ahead = [min(min(C.NEVER, matrix[4 * s + e] + ahead[e]) for e in range(4)) for s in range(4)]
    state, audit = C.START, ""
    for i, (block, ahead) in enumerate(zip(cuts, reversed(known))):
        piece, _, state = C.align(*block, state, ahead, i == len(cuts) - 1)
        audit += piece
    return audit


def test_blocks_as_whole():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 24)
        initials = [rng.choice("suaua") for _ in range(n)]
        faults = [rng.choice(["", "", "b", "d", "t"]) for _ in range(n)]
        whole = C.align(initials, faults)[0]
        for size in (1, 2, 5):
            assert chained(initials, faults, size) == whole, (initials, faults, size)


def talks(seed, n=60):
    rng = random.Random(seed)
    say = lambda: rng.choice(["Yes.", "No!", "Why?", "hm", "Well. ", "a b c.\n", "Étrange", "", " \t"]) + rng.choice(["", "", " ok."])
    rows = []
    for c in range(n):
        size = rng.randint(1, 7)
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool"]) if rng.random() < 0.2 else
                  "user" if t % 2 == 0 else "assistant", say()) for t in range(size) if rng.random() < 0.9]
    rows += [(100, None, "user", "a."), (100, None, None, None), (100, 3, "", "x."), (101, None, "user", "q?"), (None, 0, "user", "Hi."),
             (None, 1, "assistant", None), (102, 0, "user", "same."), (102, 0, "user", "same."), (102, 0, "assistant", "b."),
             (102, 9, "assistant", "same."), (103, 0, "user", "")]
    return rows


@pytest.mark.parametrize("turns", [1024, 2])
def test_report_as_plain(spark, turns):
    rows = talks(turns)
    df = frame(spark, rows)
    now = C.damaged(df)
    assert sorted(map(tuple, now.collect()), key=str) == sorted(plain_damage(rows), key=str)
    assert got(C.report(df, now, turns=turns)) == plain_report(rows, plain_damage(rows))


def test_a_long_conversation_spreads_over_tasks(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t} {'x' * 50}" + rng.choice([".", ""])) for t in range(6000)]
    df = frame(spark, rows + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")], 8)
    cut = C.blocks(df, turns=500)
    assert cut.where("id = 1").count() >= 12
    pieces = C.repair(df, turns=500)
    one = C.audits(pieces).where("conv_id = 1").head()
    initials = [r[2][0] for r in rows]
    faults = ["" if r[3].endswith(".") else "t" for r in rows]
    assert one["audit"] == C.align(initials, faults)[0] and one["cost"] == script(one["audit"], initials, faults)
    told = sorted((r["block"], r["at"], r["role"], r["text"]) for r in C.repaired_turns(pieces).where("conv_id = 1").collect())
    assert hashlib.sha256("\n".join(f"{r}:{t}" for *_, r, t in told).encode()).hexdigest() == one["repaired_sha256"]


def test_empty_table(spark):
    df = frame(spark, [], 1)
    assert got(C.report(df, C.damaged(df))) == []


def test_text_of_a_megabyte_and_string_keys(spark):
    rows = [("k", 0, "user", "x" * 1_000_000 + "."), ("k", 1, "assistant", "y" * 3_000_000 + "."), ("k", 2, "user", "z.")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    row = C.report(df, df).head()
    assert (row["cost"], row["audit"]) == (2, "KKKI")

"""Personal data: seeds against plain patterns, the graph against a plain version, contexts that reveal unseen identifiers."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pytest

from mailsift.llm import pii

SCHEMA = "doc_id bigint, text string, h int, base string, found string, edges int, added int, spans string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "b", "f", 2, 3, "s") for i, t in rows], SCHEMA).repartition(parts)


def plain_seeds(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)]
    return [(k, *m.span()) for k, (p, good) in enumerate(rules) for m in re.finditer(p, text) if good(m[0])]


def test_seeds_as_plain_patterns():
    rng = random.Random(1)
    pieces = ["1", "23", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "@", ".", "-", "+", " ", "(", ")", "ab", "a.b",
              "x@y.z", "+1 (017) 555-7713", "00", "é", "😀", "%", "_", "10.0.0.1", "999.1.1.1", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.seeds(text) == plain_seeds(text), text
        spans = pii.candidates(text, pii.seeds(text))
        taken = sorted([*((a, b) for _, a, b in pii.seeds(text))])
        assert all(b <= c or d <= a for _, a, b in spans for c, d in taken)


@pytest.mark.parametrize("text", ["9" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "+1 " * 300_000, "a@" * 400_000,
                                  "1 " * 500_000, "a.b-" * 250_000 + "@", "@a.b" * 200_000, "(" * 500_000, "1:" * 400_000])
def test_long_runs_take_linear_time(text):
    start = time.process_time()
    pii.candidates(text, pii.seeds(text))
    assert time.process_time() - start < 8


def corpus(seed, n=400):
    """Identifiers after telling words, numbers of the same shape after other words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3))
    number = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    rows, hidden = [], set()
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(3, 12)))
        kind = i % 8
        if kind == 0:
            text += f" ring me on +1 ({number(3)}) {number(3)}-{number(4)} " + word()
        elif kind == 1:
            text += f" write mail to {word()}@{word()}.example.com today " + word()
        elif kind == 2:
            text += f" the order number {number(3)}-{number(3)}-{number(4)} was " + word()
        elif kind == 3 and i % 16 == 3:
            there = f"{number(3)} {number(3)} {number(4)}"
            text += " ring me on "
            hidden.add((i, pii.PHONE, len(text), len(text) + len(there)))
            text += there + " " + word()
        elif kind == 4 and i % 16 == 4:
            there = f"{word()} (at) {word()} (dot) org"
            text += " write mail to "
            hidden.add((i, pii.EMAIL, len(text), len(text) + len(there)))
            text += there + " today " + word()
        rows.append((i, text))
    return rows, hidden


def test_contexts_reveal_unseen_identifiers(spark):
    rows, hidden = corpus(2)
    found = pii.find(frame(spark, rows)).collect()
    added = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in found for s in r["added"]}
    assert len(hidden) > 40 and added == hidden
    texts = dict(rows)
    for r in found:
        assert [tuple(s) for s in r["base"]] == plain_seeds(texts[r["doc_id"]])


def plain_scores(edges, seeded, support, precision, rounds):
    by_pattern, by_instance = defaultdict(set), defaultdict(set)
    for p, i in edges:
        by_pattern[p].add(i)
    against = {p: sum(len(by_pattern[q]) for q in by_pattern if q != p and q.split("|")[1] == p.split("|")[1]) for p in by_pattern}
    by_pattern = {p: i for p, i in by_pattern.items() if len(i) >= support}
    for p, ids in by_pattern.items():
        for i in ids:
            by_instance[i].add(p)
    scores = dict.fromkeys(seeded, 1.0)
    for _ in range(rounds):
        good = {}
        for p, ids in by_pattern.items():
            known = sum(scores.get(i, 0.0) for i in ids)
            sure = known / (known + pii.UNKNOWN * (len(ids) - known) + against[p] + 1)
            if round(known, 9) >= support and sure >= precision:
                good[p] = sure
        fresh = {i: 1 - math.prod(1 - good[p] for p in ps if p in good) for i, ps in by_instance.items() if ps & good.keys()}
        scores = {**fresh, **dict.fromkeys(seeded, 1.0)}
    return scores


def test_scores_as_plain_over_rounds(spark):
    rng = random.Random(4)
    edges = [(f"{'ab'[p % 7 == 0]}|{p - (p % 7 == 0)}", f"{i}") for p in range(30) for i in rng.sample(range(60), rng.randint(1, 14)) if i % 6 or p % 3]
    pairs = [{"pattern": p, "instance": i.encode(), "seed": int(i) < 40} for p, i in edges]
    scanned = spark.createDataFrame([([x],) for x in pairs + pairs[:50]],
                                    "edges array<struct<pattern:string,instance:binary,seed:boolean>>")
    seeded = {x["instance"] for x in pairs if x["seed"]}
    want = plain_scores([(x["pattern"], x["instance"]) for x in pairs], seeded, 4, 0.5, 3)
    got = {bytes(r["instance"]): r["score"] for r in pii.bootstrap(scanned, 4, 0.5, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(0 < v < 1 for v in got.values())


def test_odd_rows_and_digest_columns(spark):
    rows, _ = corpus(5, 40)
    rows += [(900, None), (901, ""), (None, "a@b.cc"), (None, "a@b.cc"), (902, "é +49 30 1234567 10.1.2.3 4111111111111111")]
    rows += [(903 + i, rows[0][1]) for i in range(30)] + [(5, rows[5][1])]
    got = pii.digest_columns(pii.find(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        spans = plain_seeds(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(k == n for k, *_ in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert pii.find(frame(spark, [], 1)).collect() == []

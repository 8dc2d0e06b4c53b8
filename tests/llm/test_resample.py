"""Importance resampling against a plain version, runs over newlines included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from mailsift.llm import resample

SCHEMA = "doc_id bigint, text string, weight double, score double, _words string, `rank` string, h int, found int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 0.5, 1.0, "x", "y", 3, 4) for i, t in rows], SCHEMA).repartition(parts)


def plain_features(text, most):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i:i + m]) for m in range(1, most + 1) for i in range(len(words) - m + 1)]


def plain(rows, aims, percent, most, buckets=10_000, least=20, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *plain_features(t, most)) for i, t in rows]
    s = Counter(place(f) for _, _, fs in each for f in fs)
    t = Counter(place(f) for a in aims for f in plain_features(a, most)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000.0 * math.log(((t[b] + 1) * (total_s + buckets)) / ((s[b] + 1) * (total_t + buckets))))
            for b in range(buckets)]
    out = []
    for i, n, fs in each:
        weight = sum(gain[place(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0]))
    ranks = {id(x): r for r, x in enumerate(fit[:percent * len(fit) // 100], 1)}
    return sorted([(*x[:4], ranks.get(id(x))) for x in out], key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Éa", "ñu2", "alpha", "BETA", "gamma", "x", "数", "w9", "😀b", "the", "of"]
    line = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "-", ", ", "\t", "\r"]) for _ in range(rng.randint(0, 12)))
    shared = [line() for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(shared) if rng.random() < 0.5 else line() for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n \n"), (203, "one\ntwo\nthree\nfour"), (None, rows[0][1]), (None, rows[1][1]),
             (204, "long " * 30_000), (5, rows[5][1]), (5, rows[5][1]), (6, rows[7][1])]
    return rows + [(300 + i, rows[3][1]) for i in range(60)], [line() + "\n" + line() for _ in range(10)] + [None, "", "zz top"]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_resample_as_plain(spark, most):
    rows, aims = corpus(most)
    target = spark.createDataFrame([(a,) for a in aims], "text string")
    got = resample.resample(frame(spark, rows), target, 30, most=most).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows, aims, 30, most)


def test_small_buckets_and_other_names(spark):
    rows, aims = corpus(9)
    target = spark.createDataFrame([(a,) for a in aims], "item string")
    docs = frame(spark, rows).withColumnRenamed("text", "weight text")
    got = resample.resample(docs, target, 100, text="weight text", target_text="item", buckets=7, least=3).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows, aims, 100, 1, 7, 3)


@pytest.mark.parametrize("rows, aims", [([], ["a b"]), ([(1, "a " * 25), (2, "b")], []), ([], [])])
def test_empty_tables(spark, rows, aims):
    target = spark.createDataFrame([(a,) for a in aims], "text string")
    got = resample.resample(frame(spark, rows), target, 50).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows, aims, 50, 1)


def test_features_of_shared_lines_are_counted_once(spark):
    rows = frame(spark, [(i, f"same line here\nown {i}") for i in range(50)]).select("text")
    lines = resample.line_table(rows, 2, 100).collect()
    assert len(lines) == 51 and max(r["times"] for r in lines) == 50

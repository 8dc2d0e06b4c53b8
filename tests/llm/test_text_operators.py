"""SimHash, I-Match, repeated strings, decontamination and BPE against plain versions on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from mailsift.llm import bpe, decontam, imatch, simhash, suffix_dedup

SCHEMA = "doc_id bigint, text string, score double, features string, _row string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 0.5, "x", "y") for i, t in rows], SCHEMA).repartition(parts)


def prose(rng, n, words=("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma "
                         "tau upsilon phi chi psi omega one two three four five six seven eight nine ten").split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n))


# --- SimHash ------------------------------------------------------------------------------

def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(points, k):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(points)):
        for j in range(i):
            if bin(int(points[i]) ^ int(points[j])).count("1") <= k:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b", "A b C d", "É a\x0bb c d É", "x " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def clustered(seed, centres, size, flips):
    rng = np.random.default_rng(seed)
    out = []
    for c in rng.integers(0, 1 << 63, centres, np.uint64):
        for _ in range(size):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return np.unique(np.array(out, np.uint64))


def groups_of(points, a, b):
    root = {int(p): int(p) for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x, y in zip(a, b):
        p, q = find(int(x)), find(int(y))
        root[max(p, q)] = min(p, q)
    least = {}
    for p in points:
        least.setdefault(find(int(p)), set()).add(int(p))
    return sorted(map(sorted, least.values()))


@pytest.mark.parametrize("seed,centres,size,flips", [(1, 400, 1, 0), (2, 12, 40, 4), (3, 3, 150, 6), (4, 60, 8, 9)])
def test_tree_finds_all_links(seed, centres, size, flips):
    points = clustered(seed, centres, size, flips)
    expected = plain_groups(points, 3)
    a, b = simhash.spanning_links(points, 3)
    assert len(a) < len(points)
    assert groups_of(points, a, b) == groups_of(points, points, points[expected])


@pytest.mark.parametrize("k", [0, 1, 3])
def test_links_with_small_shards(spark, k):
    points = clustered(5, 6, 60, 5)
    df = spark.createDataFrame([(int(np.int64(np.uint64(p))),) for p in points.view(np.int64)], "fp bigint")
    got = simhash.links(df, k, largest=20).toPandas()
    expected = plain_groups(points, k)
    assert groups_of(points, got.a.to_numpy().view(np.uint64), got.b.to_numpy().view(np.uint64)) == groups_of(
        points, points, points[expected])


def test_near_duplicates_odd_rows(spark):
    rng = random.Random(3)
    base = prose(rng, 400)
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(7, base), (3, near), (9, base), (9, base), (1, None), (2, ""), (None, prose(rng, 30)), (4, "one"), (5, "ONE")]
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(7, 3), (3, 3), (9, 3), (1, 1), (2, 1), (None, None), (4, 4), (5, 4)}
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


# --- I-Match ------------------------------------------------------------------------------

def test_imatch_probe(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)] + ["", "!!", "a"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None), (1001, texts[5])]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in imatch.probe(df, imatch.lexicon(df, least=0.02)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 4
        r = got[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256((text[:len(text) - k] + after[:k]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[1001].fingerprint == got[15].fingerprint
    long = [got[k] for k, t in ordered if t and len(t) > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)


def plain_imatch(text, lexicon):
    """Subset hashes of a text, term by term with whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def digest(hashes):
        return xxhash.xxh64_intdigest(b"".join(h.to_bytes(8, "little") for h in hashes)) >> 40 or 1

    found = {w for w in re.findall(r"[^\W_]+", text.lower())}
    hashes = [xxhash.xxh64_intdigest(w) for w in sorted(found & lexicon) or sorted(found) or [text]]
    out = [digest(hashes)]
    for level in range(1, imatch.LEVELS + 1):
        for seed in range(1, imatch.SEEDS + 1):
            drawn = [mix(h ^ (seed * 0x9E3779B97F4A7C15 & mask)) for h in hashes]
            kept = [d for d in drawn if d < 1 << (64 - 2 * level)]
            out.append(digest(kept) if kept else 0)
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    pairs = [[(x, y) for x, y in zip(a[i:i + imatch.SEEDS], b[i:i + imatch.SEEDS]) if x or y]
             for i in range(1, len(a), imatch.SEEDS)]
    agree = [sum(x == y for x, y in level) for level in pairs]
    shares = [n / len(level) for n, level in zip(agree, pairs) if len(level) >= imatch.ENOUGH]
    if shares:
        return max(shares)
    return sum(agree) / sum(map(len, pairs)) if any(pairs) else 0.0


def test_imatch_as_plain(spark, monkeypatch):
    """Lexicon, fingerprints and likeness of every row, whatever the number of parts."""
    monkeypatch.setattr(imatch, "PART_BYTES", 1 << 10)
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.choice([1, 5, 60, 400]))) for i in range(40)] + [(50, None), (51, "!?"), (52, "zz zz")]
    rows.append((53, rows[7][1]))
    df = frame(spark, rows)
    sets = [set(re.findall(r"[^\W_]+", (t or "").lower())) for _, t in rows]
    counts = {w: sum(w in s for s in sets) for w in set().union(*sets)}
    band = {w for w, n in counts.items() if 0.05 * len(rows) <= n <= 0.5 * len(rows)}
    lex = imatch.lexicon(df, least=0.05)
    assert set(lex.position) == band and 0 < len(band) < len(counts)
    got = {r.doc_id: r for r in imatch.probe(df, lex).collect()}
    marks = [plain_imatch(t or "", band) for _, t in rows]
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        other = plain_imatch(text[:len(text) - k] + after[:k], band)
        r = got[key]
        assert r.fingerprint == "".join(f"{x:06x}" for x in marks[i])
        assert r.edited_fingerprint == "".join(f"{x:06x}" for x in other)
        assert r.near_edited == plain_likeness(marks[i], other)
        assert r.near_next == plain_likeness(marks[i], marks[(i + 1) % len(rows)])


def test_imatch_ties_and_empty(spark):
    df = frame(spark, [(1, "a b"), (1, "c d"), (1, "a b"), (None, "e f")])
    lex = imatch.lexicon(df)
    assert imatch.probe(df, lex).count() == 4
    assert len({r.fingerprint for r in imatch.fingerprints(df, lex).collect()}) == 3
    none = frame(spark, [])
    assert imatch.probe(none, imatch.lexicon(none)).count() == 0
    only = frame(spark, [(8, "only this row")])
    assert imatch.probe(only, imatch.lexicon(only)).head().near_next == 1.0


# --- repeated strings ---------------------------------------------------------------------

def plain_cut(texts, n):
    seen = {}
    for t in texts:
        for p in range(len(t) - n + 1):
            seen[t[p:p + n]] = seen.get(t[p:p + n], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - n + 1):
            if seen[t[p:p + n]] > 1:
                gone[p:p + n] = [True] * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def pieces(seed, alphabet, n):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(20, 90)) for _ in range(5)]
    texts = ["".join(rng.choice(shared) if rng.random() < 0.5 else word(rng.randint(0, 50)) for _ in range(rng.randint(0, 7)))
             for _ in range(n)]
    return texts + [texts[0], "", shared[0][:39], "é" * 70, "ab" * 80]


@pytest.mark.parametrize("largest", [4096, 2])
@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefghij é"), (2, "ab"), (3, "abcd")])
def test_repeats(spark, seed, alphabet, largest):
    texts = pieces(seed, alphabet, 40)
    rows = list(enumerate(texts)) + [(500, None), (None, texts[1]), (3, texts[3])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=40, largest=largest, run_windows=8).collect()
    expected = plain_cut([(t or "").encode() for _, t in rows], 40)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (repr(k), *e) for (k, _), e in zip(rows, expected))
    assert suffix_dedup.remove_repeats(frame(spark, []), length=40).count() == 0


def test_large_groups_are_split_by_content(spark):
    """Many surroundings of one anchor, of which a few share windows to the left, to the right, or across it."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    middle, right, left = word(14), word(30), word(30)
    texts = [word(40) + middle + word(40) for _ in range(60)]
    texts += [word(40) + middle + right + word(9) for _ in range(5)] + [word(9) + left + middle + word(40) for _ in range(5)]
    texts += [word(20) + left[-13:] + middle + right[:13] + word(20) for _ in range(4)]
    want = sorted(plain_cut([t.encode() for t in texts], 40))
    for largest in (1, 8):
        got = suffix_dedup.remove_repeats(frame(spark, list(enumerate(texts))), length=40, gram=14, largest=largest, run_windows=8)
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want


def test_ranges_are_merged_before_they_are_gathered(spark):
    rows = [(1, s, s + 10) for s in range(0, 5000, 5)] + [(1, 6000, 6010), (1, 6000, 6004), (1, 6011, 6012), (2, 0, 1), (2, 0, 1), (2, 1, 3)]
    got = suffix_dedup.merged(spark.createDataFrame(rows, "id bigint, start bigint, stop bigint"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5005), (1, 6000, 6010), (1, 6011, 6012), (2, 0, 3)]


def test_repeats_across_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    data = np.frombuffer(pieces(9, "abc", 30)[0].encode() * 5, np.uint8)
    start, windows, *_ = suffix_dedup.segments_of(data, np.array([len(data)]), suffix_dedup.Hasher(200), 40, 14)
    covered = [p for a, n in zip(start.tolist(), windows.tolist()) for p in range(a, a + n)]
    assert covered == list(range(len(data) - 39))


# --- decontamination ----------------------------------------------------------------------

def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([3, 9, 20, 45, 60]))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    docs, planted = [], set()
    for d in range(120):
        text = prose(rng, rng.randint(0, 300)).split()
        if d % 3 == 0:
            i, t = items[d % 30]
            words = t.split()
            if d % 2 and len(words) >= 20:
                words[len(words) // 3] = "otherword"
                del words[len(words) // 2]
            at = rng.randint(0, len(text))
            text[at:at] = words
            planted.add((d, i))
        docs.append((d, " ".join(text)))
    rows = docs + [(500, None), (501, ""), (502, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), bench).collect()}
    assert got == planted | {(502, 0)}
    in_blocks = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, rows), bench, block=12).collect()}
    assert in_blocks == got
    flagged = decontam.with_leaks(frame(spark, rows), bench, ["doc_id", "score"]).where(F.size("leaks") > 0)
    assert {r.doc_id for r in flagged.collect()} == {d for d, _ in got}
    assert decontam.leaks(frame(spark, []), bench).count() == 0
    assert decontam.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_of_cut_items(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 20 + 2 * i), prose(rng, 4) if i % 2 else None) for i in range(16)]
    docs = []
    for i, t, answer in items:
        words = t.split()
        n = -(-len(words) * 4 // 5)
        for at, part in ((i, words[:n]), (100 + i, words[-n:]), (200 + i, words[:n] + [answer or ""])):
            docs.append((at, " ".join([prose(rng, 50), *part, prose(rng, 50)])))
    bench = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    found = decontam.leaks(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d % 100) for d, _ in docs}
    assert all(r.answer_share is None for r in found)
    # A named answer has to be there too; a null one asks for nothing.
    named = decontam.leaks(frame(spark, docs), bench, answer="answer").collect()
    assert {(r.doc_id, r.item_id) for r in named} == {(d, d % 100) for d, _ in docs if d % 2 == 0 or d >= 200}
    assert {r.answer_share for r in named if r.item_id % 2} == {1.0}


def test_leaks_of_short_items(spark):
    rng = random.Random(6)
    frequent = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(frequent) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    items = [(1000 + i, " ".join(rng.choice(frequent) for _ in range(30))) for i in range(10)]
    for i in range(70):
        words = rng.choice(texts).split()
        n = min(1 + i % 7, len(words))
        at = rng.choice([0, len(words) - n, rng.randint(0, len(words) - n)])
        items.append((i, " ".join(words[at:at + n])))
    items += [(70, items[10][1]), (71, "w0 absent"), (72, "W1, w2!")]
    short = [(i, t) for i, t in items if i < 1000]
    spaced = {i: f" {' '.join(decontam.words(t))} " for i, t in short}
    expected = {(d, i) for d, t in enumerate(texts) for i, _ in short if spaced[i] in f" {t} "}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = [r for r in decontam.leaks(frame(spark, list(enumerate(texts))), bench).collect() if r.item_id < 1000]
    assert len(found) == len(expected) and {(r.doc_id, r.item_id) for r in found} == expected
    first = {(r.doc_id, r.item_id): r.word for r in found}
    assert all(f" {texts[d]} "[:f" {texts[d]} ".index(spaced[i])].count(" ") == w for (d, i), w in first.items())
    # The answer of a short item may stand at any of its places, not only at the first.
    far = " ".join(["w1 w2", *["w3"] * 60, "w1 w2 w9"])
    named = spark.createDataFrame([(1, "w1 w2", "w9"), (2, "w1 w2", "w8")], "item_id bigint, text string, answer string")
    got = decontam.leaks(frame(spark, [(1, far)]), named, answer="answer").collect()
    assert [(r.doc_id, r.item_id, r.word) for r in got] == [(1, 1, 62)]


def test_recall_against_an_exact_search(spark):
    """Items copied, with a quarter of their words replaced (any, or the heaviest), and with moved parts: of the pairs whose
    region has the share, nine in ten are found, and no others."""
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdgkmt" for b in "aeiou" for c in "lnrs"]
    draw = lambda n: [vocabulary[int(len(vocabulary) * rng.random() ** 2)] for _ in range(n)]
    items = {i: draw(rng.randint(14, 50)) for i in range(60)}
    common = {w: sum(x.count(w) for x in items.values()) for w in vocabulary}
    docs = []
    for i, item in items.items():
        for mode in ("copy", "any", "heaviest", "moved", "half"):
            w, m = list(item), len(item)
            if mode in ("any", "heaviest"):
                gone = rng.sample(range(m), m // 4) if mode == "any" else sorted(range(m), key=lambda j: common[w[j]])[:m // 4]
                for j in gone:
                    w[j] = "elsewhere"
            elif mode == "moved":
                w = w[m // 5:] + w[:m // 5]
            elif mode == "half":
                w = w[:m // 2]
            docs.append((len(docs), " ".join(draw(rng.randint(0, 90)) + w + draw(rng.randint(0, 90)))))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, docs), bench).collect()}
    exact = set()
    for d, text in docs:
        words = text.split()
        for i, item in items.items():
            size, spare = -(-len(item) // 4) * 4 + 4, max(4, len(item) // 4)
            if sum(w in set(item) for w in words) < 0.7 * len(item):
                continue
            for a in range(0, len(words), 4):
                region = words[max(0, a - spare):a + size + spare]
                terms = {w: n for n, w in enumerate(dict.fromkeys(item))}
                if decontam.common_subsequence([terms[w] for w in item], [terms.get(w, -1) for w in region]) >= 0.7 * len(item) - 1e-9:
                    exact.add((d, i))
                    break
    assert len(exact) > 200 and got <= exact and len(got) >= 0.9 * len(exact), (len(got), len(exact))


def test_sample_bound_holds_for_copies(spark, monkeypatch):
    rng = random.Random(9)
    singles = [prose(rng, 40) for _ in range(400)]
    candidates = [prose(rng, 40) for _ in range(200)]
    hashed = spark.createDataFrame([(t,) for t in candidates], "text string").select("text", F.xxhash64("text").alias("h"))
    hot = min(hashed.collect(), key=lambda r: r.h % 1_000_000).text  # the first to be drawn
    rows = list(enumerate(singles + [hot] * 200))
    bench = [(i, t, None) for i, t in enumerate(singles[:5] + [hot])]
    cut = []

    def counted(df, name):
        cut.append(df.count())
        return df
    monkeypatch.setattr(decontam, "written", counted)
    assert decontam.build_index(frame(spark, rows).select("text"), bench, sample=30) is not None
    assert 0 < cut[0] <= 60  # a passage each, 200 and more with every copy


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(-1, 5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(a, b) == table[-1][-1]


# --- byte-level BPE -----------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_tokenizer():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe(spark, reference_tokenizer):
    rng = random.Random(4)
    alphabet = "aàbZ½Ⅷ² 19\n\t\r's're  \x1c\x85漢😀𝐀٣_"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "<|endoftext|>"), (903, "ab" * 3000), (904, " " * 500 + "x"), (904, "again"), (None, "k")]
    coded = bpe.encode(frame(spark, rows), RANKS, public_tokenizers.PATTERN, decoded=True)
    expected = sorted((repr(k), (t or "").encode(), np.array(reference_tokenizer.encode_ordinary(t or ""), "<u4").tobytes())
                      for k, t in rows)
    assert sorted((repr(r.doc_id), bytes(r.decoded), bytes(r.ids)) for r in coded.collect()) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in coded.collect())
    assert sorted(bytes(r.decoded) for r in bpe.decode(coded, RANKS).collect()) == sorted(e[1] for e in expected)
    assert bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_perfect_hash(n):
    keys = [f"key{i}".encode() for i in range(n)]
    found = bpe.PerfectHash(keys)
    assert sorted(found.slot(k) for k in keys) == list(range(n))


def test_decomposition_sees_all_passages_as_a_dense_one(spark):
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 30, rng.integers(1, 9)) for _ in range(50)]
    weight, basis = rng.random(30).astype(np.float32) + 0.5, rng.standard_normal((30, 4)).astype(np.float32)
    dense = np.array([np.bincount(x, minlength=30) for x in lists]) * weight
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    out, ends = np.zeros((30, 4)), np.cumsum([len(x) for x in lists])
    decontam._through(np.concatenate(lists), np.append(0, ends[:-1]), weight, basis, 1.0, out)
    assert np.allclose(out, dense.T @ (dense @ basis), atol=1e-4)
    # 5000 documents of one pair of words, 5000 of another, and an item with both: the leading vector weighs all of them.
    docs = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("alpha beta x"), "id")).otherwise(
        F.concat(F.lit("gamma delta x"), "id")).alias("text"))
    term = {"alpha": 0, "beta": 1, "gamma": 2, "delta": 3}
    seen = []
    spy = decontam.written
    decontam.written = lambda df, name: seen.append(spy(df, name)) or seen[-1]
    try:
        decontam._latent(docs, [decontam.Item(1, [0, 1, 2, 3], [])], term, np.ones(4, np.float32))
    finally:
        decontam.written = spy
    assert [x.count() for x in seen] == [10_000]


def test_frequent_terms_are_dense_and_passages_are_cut_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 40, rng.integers(1, 60)) for _ in range(30)]
    weight, basis = rng.random(40).astype(np.float32) + 0.5, rng.standard_normal((40, 4)).astype(np.float32)
    dense = np.array([np.bincount(x, minlength=40) for x in lists]) * weight
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    ends = np.cumsum([len(x) for x in lists])
    for some in (1, 13, 40):
        monkeypatch.setattr(decontam, "FREQUENT", some)
        assert sorted(np.flatnonzero(decontam.frequent(weight) >= 0)) == sorted(np.argsort(weight)[:some])
        out = np.zeros((40, 4))
        decontam._through(np.concatenate(lists), np.append(0, ends[:-1]), weight, basis, 1.0, out)
        assert np.allclose(out, dense.T @ (dense @ basis), atol=1e-4)
    texts = [np.full(n, -1) if n == 50 else rng.integers(-1, 3, n) for n in (0, 200, 50, 0, 7, 48, 49)]
    plain = [[x for i in range(0, len(t), decontam.PASSAGE) if (x := [int(v) for v in t[i:i + decontam.PASSAGE] if v >= 0])] for t in texts]
    assert decontam._passages(np.concatenate(texts), np.cumsum([len(t) for t in texts])).to_pylist() == plain


def test_words_of_documents_are_looked_up_once_for_a_block(spark):
    rows = [(i, f"alpha beta gamma delta epsilon zeta eta theta iota kappa number {i}") for i in range(5)] + [(9, None)]
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    seen = []
    spy = decontam.written
    decontam.written = lambda df, name: seen.append((name, spy(df, name))) or seen[-1][1]
    try:
        found = decontam.leaks(frame(spark, rows), bench)
    finally:
        decontam.written = spy
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 3, 4]
    assert [name for name, _ in seen] == ["coded", "passages"]
    assert "text" not in seen[0][1].columns and seen[0][1].count() == 6

"""I-Match fingerprints over randomised lexicons.

Lexicon: the terms (runs of letters and digits, lower case) whose share of documents lies within a band,
that is, whose inverse document frequency does. At most (mean distinct terms of a document) / LEAST_SHARE
terms can be in the band, however large the corpus, so it is broadcast; its size is checked before.

Fingerprint: the distinct lexicon terms of a text, sorted, are hashed once as a whole and then within
randomised subsets of the lexicon, in the same order. A subset is given by a seed and a level: level l keeps each
term with probability 4^-l. A coarse subset changes with nearly every edit, a fine one only if the edit touches its
few terms, so of the finest subsets that still hold a term about as many agree as the texts share terms.

Likeness (0 to 1): among the subsets of a level that hold a term of either text, the share whose hashes
agree; of the levels with enough such subsets the highest, else over all subsets. Texts with the same terms
have 1.

Counting terms combines in tasks and again before the shuffle, so a term of all documents costs one row a
task. Fingerprinting is row by row. The neighbour probe moves each text once, by ranges of ids that hold about
PART_BYTES of text each.

Defined cases: a null text is empty; a text without a lexicon term is fingerprinted by all its terms, and
one without any term by its characters; ties of ids are ordered by a hash of the text; null ids come first.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.common import range_of, slices, small_batches, texts

#: The band: a term of the lexicon is in at least and at most this share of the documents.
LEAST_SHARE, MOST_SHARE = 1 / 2000, 1 / 2
#: Terms that may be broadcast; a corpus beyond it needs a narrower band.
MOST_TERMS = 2_000_000
SEEDS, LEVELS = 24, 5
#: Subsets that must hold a term for a level to count.
ENOUGH = 6
#: Distinct terms a counting task holds before it passes its counts on.
_COUNTED = 200_000
_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEED = (np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
_BORDERS = np.arange(SEEDS + 1)
_HASHES = 1 + SEEDS * LEVELS
#: Text bytes of a part of the neighbour probe.
PART_BYTES = 64 << 20


def terms(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Lexicon:
    """Terms in sorted order; a term is known by its position."""

    def __init__(self, words: list[str]):
        self.position = {w: i for i, w in enumerate(sorted(words))}
        self.hash = np.array([xxhash.xxh64_intdigest(w) for w in sorted(words)], np.uint64)

    def fingerprint(self, text: str) -> np.ndarray:
        """24-bit hashes: of all terms, then by level and seed; 0 for a subset without a term."""
        found = terms(text)
        known = np.array([p for p in map(self.position.get, found) if p is not None], np.int64)
        if len(known):
            known.sort()
            h = self.hash[known]
        else:
            h = np.array([xxhash.xxh64_intdigest(t) for t in sorted(found)] or [xxhash.xxh64_intdigest(text)], np.uint64)
        out = np.empty(_HASHES, np.uint32)
        out[0] = xxhash.xxh64_intdigest(h.tobytes()) >> 40 or 1
        drawn = _mixed(h[None, :] ^ _SEED).ravel()
        kept = np.flatnonzero(drawn >> np.uint64(62) == 0)
        drawn, seed = drawn[kept], kept // len(h)
        out[1:] = 0
        for level in range(1, LEVELS + 1):
            if level > 1:
                deeper = drawn >> np.uint64(64 - 2 * level) == 0
                drawn, seed = drawn[deeper], seed[deeper]
            borders = (8 * np.searchsorted(seed, _BORDERS)).tolist()
            data, base = drawn.tobytes(), 1 + (level - 1) * SEEDS
            for i, (a, b) in enumerate(zip(borders, borders[1:])):
                if b > a:
                    out[base + i] = xxhash.xxh64_intdigest(data[a:b]) >> 40 or 1
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a[0] == b[0] and (a == b).all():
        return 1.0
    held = ((a | b) != 0)[1:].reshape(LEVELS, SEEDS)
    same = held & (a == b)[1:].reshape(LEVELS, SEEDS)
    many, agree = held.sum(axis=1), same.sum(axis=1)
    levels = many >= ENOUGH
    if levels.any():
        return float((agree[levels] / many[levels]).max())
    return float(agree.sum() / many.sum()) if many.sum() else 0.0


def as_text(hashes: np.ndarray) -> str:
    """Six hex digits for each hash."""
    return hashes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()


def lexicon(df: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    """The terms of the band, counted over all documents."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        schema = pa.schema([("term", pa.string()), ("n", pa.int64())])
        for part in slices(batches, "_text"):
            for t in texts(part.column(0)):
                counts.update(terms(t))
            if len(counts) > _COUNTED:
                yield from pa.Table.from_arrays([list(counts), list(counts.values())], schema=schema).to_batches(10_000)
                counts.clear()
        yield from pa.Table.from_arrays([list(counts), list(counts.values())], schema=schema).to_batches(10_000)

    documents = df.count()
    counted = df.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "term string, n bigint").groupBy("term").agg(
        F.sum("n").alias("n"))
    band = counted.where((F.col("n") >= least * documents) & (F.col("n") <= most * documents)).select("term")
    words = [r.term for r in band.limit(MOST_TERMS + 1).collect()]
    if len(words) > MOST_TERMS:
        raise ValueError("the lexicon is too large to broadcast; raise the least share")
    return Lexicon(words)


def fingerprints(df: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) row by row."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            out = [as_text(shared.value.fingerprint(t)) for t in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], [key, "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def in_order(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (part, extra, key, text) sorted by key within parts that follow one another in key order.

    Each part ends with a copy, marked extra, of the row that follows its last one in the whole table; the
    table's first row follows its last.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    total, count = rows.agg(F.sum(F.octet_length("text").cast("bigint")), F.count(F.lit(1))).head()
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // PART_BYTES))
    mean = max(1, (total or 0) // max(1, count))
    # A key counts once for each mean length of its text, so shares of the counts are shares of the bytes.
    weighed = rows.select("key", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / mean))))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    starts = sorted(set(weighed.agg(F.percentile_approx("key", shares, 8 * parts)).head()[0] or []))
    rows = rows.withColumn("part", F.coalesce(range_of(F.col("key"), starts) if starts else F.lit(0), F.lit(0)).cast("bigint")
                           ).withColumn("tie", F.xxhash64("text"))
    least = F.min(F.struct(F.col("key").isNotNull().alias("has"), "key", "tie"))
    firsts = sorted((r.part, r.first.key, r.first.tie) for r in rows.groupBy("part").agg(least.alias("first")).collect())
    if not firsts:
        return rows.select("part", F.lit(0).alias("extra"), "key", "text", "tie")
    before = spark.createDataFrame([(firsts[i - 1][0], k, t) for i, (_, k, t) in enumerate(firsts)],
                                   "part bigint, first bigint, first_tie bigint")
    extra = rows.drop("part").join(F.broadcast(before), F.col("key").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    whole = rows.select("part", F.lit(0).alias("extra"), "key", "text", "tie").unionByName(
        extra.select("part", F.lit(1).alias("extra"), "key", "text", "tie"))
    return whole.repartition(parts, "part").sortWithinPartitions("part", "extra", "key", "tie")


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the following one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def probe(df: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text against its edited form and against the next text in key order."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(lex)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for extra, key, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if held is None and extra:
                    continue
                mark = shared.value.fingerprint(text)
                if held is not None:
                    old_key, old_text, old_mark = held
                    changed = edited(old_text, text)
                    other = shared.value.fingerprint(changed)
                    out.append((old_key, len(old_text), hashlib.sha256(changed.encode()).hexdigest(), as_text(old_mark),
                                as_text(other), likeness(old_mark, other), likeness(old_mark, mark)))
                held = None if extra else (key, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return in_order(df, key, text).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")

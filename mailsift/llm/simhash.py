"""SimHash fingerprints and exact near-duplicate groups by vantage-point trees.

Fingerprint: words of the ASCII-lower-cased text, shingles of ``words`` words joined by one space
(fewer words: the whole sequence), XXH64 of every shingle, repeats included; a bit is 1 if it is set in
over half the hashes. A text without words has fingerprint zero.

Groups: equal fingerprints are merged first. Two fingerprints that differ in at most k bits agree in one
of k + 1 blocks of bits, so each goes to the k + 1 shards of its block values, and every linked pair meets
in one. (A vantage-point tree over all 64-bit fingerprints prunes little: distances between unrelated
ones crowd around 32, so most points lie within k of any boundary.) A shard of more than ``largest``
fingerprints is partitioned by their Hamming distance to a vantage point into rings of k + 1 distances;
points within k of a boundary also go to the next ring; a ring that is still too large is dealt into
parts, and every two parts meet in a task. Within a task a vantage-point tree finds the links: points
nearer than the median distance go inside, the others outside, and by the triangle inequality only points
within k of the median need comparing across. A task returns a spanning tree of its links, never all of them.

Defined cases: null and empty texts have fingerprint zero and link like any other; equal texts always
link; repeated rows stay; a group whose ids are all null has a null component; the component is the least
id reachable. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mailsift.llm.common import schema_with, slices, small_batches, written
from mailsift.operators.components import connected_components
from mailsift.operators.skew import join_facts

SEED = 42
#: Fingerprints of a shard that one task compares.
LARGEST = 4096
#: Points of a tree's leaf, and pairs across a boundary, that are compared directly.
LEAF, DIRECT = 48, 1 << 16
#: Shingle hashes whose bits are counted at once.
_COUNTED = 1 << 18


def fingerprint(raw: bytes, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 bytes."""
    tokens = raw.lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(tokens) - words + 1], ends[words - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())),
                         np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at:at + _COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp) with the fingerprint as a signed 64-bit number."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            raw = part.column(1).to_pylist()
            fps = np.array([fingerprint(v or b"", words) for v in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], [key, "fp"])

    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("binary").alias("_text"))
    return rows.mapInArrow(run, schema_with(df, [key], fp="bigint"))


class _Links:
    """Spanning links of points by a vantage-point tree; ``label`` names each point's group so far."""

    def __init__(self, points: np.ndarray, k: int):
        self.points, self.k = points, k
        self.label = np.arange(len(points))

    def _join(self, members: np.ndarray) -> None:
        groups = np.unique(self.label[members])
        if len(groups) > 1:
            self.label[np.isin(self.label, groups)] = groups[0]

    def _direct(self, a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(self.points[a][:, None] ^ self.points[b][None, :]) <= self.k
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            if self.label[a[i]] != self.label[b[j]]:
                self._join(np.array([a[i], b[j]]))

    def _from(self, vantage: int, points: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(self.points[points] ^ self.points[vantage]).astype(np.int16)
        self._join(np.append(points[d <= self.k], vantage))
        return d

    def within(self, points: np.ndarray) -> None:
        """All links among the points."""
        todo = [points]
        while todo:
            points = todo.pop()
            if len(points) <= LEAF:
                if len(points) > 1:
                    self._direct(points, points)
                continue
            vantage, points = points[0], points[1:]
            d = self._from(vantage, points)
            middle = np.median(d)
            inner = d <= middle
            todo += [points[inner], points[~inner]]
            self.across(points[inner & (d > middle - self.k)], points[~inner & (d <= middle + self.k)])

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All links between the two sets."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if not len(a) or not len(b):
                continue
            if len(a) * len(b) <= DIRECT:
                self._direct(a, b)
                continue
            if len(a) < len(b):
                a, b = b, a
            vantage, a = a[0], a[1:]
            db = self._from(vantage, b)
            da = np.bitwise_count(self.points[a] ^ self.points[vantage]).astype(np.int16)
            middle, k = np.median(db), self.k
            todo += [(a[da <= middle], b[db <= middle]), (a[da > middle], b[db > middle]),
                     (a[(da <= middle) & (da > middle - k)], b[(db > middle) & (db <= middle + k)]),
                     (a[(da > middle) & (da <= middle + k)], b[(db <= middle) & (db > middle - k)])]


def spanning_links(points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (point, first point of its group) that join all points linked by chains of steps of at most k bits."""
    if len(points) < 2:
        return points[:0], points[:0]
    found = _Links(points, k)
    found.within(np.arange(len(points)))
    _, first, group = np.unique(found.label, return_index=True, return_inverse=True)
    root = first[group]
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def _small_links(unit: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many shards of at most LEAF points at once: each point against the next 1, 2, ... of its shard."""
    a, b = [], []
    for lag in range(1, LEAF):
        same = unit[lag:] == unit[:-lag]
        if not same.any():
            break
        near = same & (np.bitwise_count(points[lag:] ^ points[:-lag]) <= k)
        a.append(points[lag:][near])
        b.append(points[:-lag][near])
    return (np.concatenate(a), np.concatenate(b)) if a else (points[:0], points[:0])


def _search(k: int):
    """Links from rows (unit, fp) that come sorted by unit."""

    def links(unit: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.array([], int)
        sizes = np.diff(np.append(starts, len(unit)))
        small = np.repeat(sizes <= LEAF, sizes)
        a, b = _small_links(unit[small], points[small], k)
        a, b = [a], [b]
        for at, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
            for side, more in zip((a, b), spanning_links(points[at:at + size], k)):
                side.append(more)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(side).view(np.int64)) for side in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, points = np.array([], np.int64), np.array([], np.uint64)
        for batch in batches:
            unit = np.concatenate((unit, batch.column(0).to_numpy(zero_copy_only=False)))
            points = np.concatenate((points, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(unit) > 1 << 16 and unit[0] != unit[-1]:
                whole = int(np.searchsorted(unit, unit[-1]))
                yield links(unit[:whole], points[:whole])
                unit, points = unit[whole:], points[whole:]
        yield links(unit, points)

    return run


def block_keys(fp, k: int) -> list:
    """The k + 1 shard numbers of a fingerprint: block and bits of the block."""
    edges = [64 * i // (k + 1) for i in range(k + 2)]
    out = []
    for block, (low, high) in enumerate(zip(edges, edges[1:])):
        bits = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) if k else fp
        out.append(F.xxhash64(F.lit(block), bits))
    return out


def links(fps: DataFrame, k: int = 3, largest: int = LARGEST) -> DataFrame:
    """(a, b): links that join all distinct fingerprints (column fp) within k bits of one another."""
    routed = written(fps.select("fp", F.explode(F.array(*block_keys(F.col("fp"), k))).alias("unit")), "routed")
    sizes = written(routed.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("vantage")), "shards")
    told = join_facts(routed, sizes.where(F.col("n") > largest).select("unit", "vantage"), "unit")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))
    ring = F.floor(distance / (k + 1))
    above = F.when(distance % (k + 1) > 0, F.array(ring, ring + 1)).otherwise(F.array(ring))
    ringed = written(told.where("vantage IS NOT NULL").select(
        "fp", F.col("unit").alias("shard"), F.explode(above).alias("ring")).select(
        "fp", F.xxhash64("shard", "ring").alias("unit")), "rings")
    sizes = ringed.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("unit", F.ceil(F.col("n") / largest).alias("parts"))
    dealt = join_facts(ringed, parts, "unit").withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    met = dealt.select("fp", "unit", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    units = told.where("vantage IS NULL").select("unit", "fp").unionByName(met.select(
        F.xxhash64("unit", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "fp"))
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_search(k), "a bigint, b bigint")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3,
                    k: int = 3) -> DataFrame:
    """(key, fp, component): every row with its fingerprint and the least id that links reach."""
    rows = written(fingerprints(df, key, text, words), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    members = connected_components(written(links(fps.select("fp"), k), "links"))
    named = written(fps.join(members.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("component", "fp")).select("fp", "root", "least"), "members")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    facts = written(join_facts(named.select("fp", "root"), least, "root").select("fp", "component"), "components")
    return join_facts(rows, facts, "fp")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, k: int = 3) -> DataFrame:
    """``df`` with one row of each group: that of the least key (null last), among equal keys of the least text hash."""
    identity = F.struct(F.col(f"`{key}`").isNull(), F.coalesce(F.col(f"`{key}`"), F.lit(0)), F.xxhash64(F.col(f"`{text}`")))
    rows = df.select(identity.alias("_identity"), F.col(f"`{text}`").alias("_whole"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    found = near_duplicates(rows.select("_identity", "_whole"), "_identity", "_whole", words, k)
    kept = written(found.select(F.col("component").alias("_identity")).distinct(), "kept")
    return rows.drop("_whole").join(kept, "_identity", "left_semi").dropDuplicates(["_identity"]).select("_row.*")

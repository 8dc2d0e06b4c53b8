"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts elsewhere, in any text, is removed.

1. Anchors. Within each window of ``length`` bytes the piece of GRAM bytes with the least hash, the leftmost
   of equals, is the window's anchor. Equal windows have the same anchor at the same offset, so only
   suffixes at anchors need sorting, about one in 128. Neighbouring windows of one anchor form a segment.
2. Segments meet by their anchor's hash; counts combine before the shuffle. An anchor that occurs once ends
   here. Segments count as equal if 128-bit BLAKE2 digests of their bytes are. If all segments of an anchor
   are equal, they are covered. Otherwise equal ones are counted, and one of each kind goes on with its bytes.
3. Suffix sort. The kinds of an anchor are sorted by the text from the anchor on, and by the text before it
   read backwards: a mergesort whose comparisons find the common extension of two suffixes by binary search
   on prefix polynomial hashes, which the bytes then verify. Common extensions of neighbours in both orders
   give those of any two kinds as running minima; left and right extension together of ``length`` or more
   are the shared windows.
4. An anchor with more kinds than LARGEST is split by content: two kinds that share a window agree in half of what a
   window holds beside its anchor, either right or left of it, so they meet by the digest of the one or of the other and
   are sorted there. Where even that leaves more than LARGEST, segments are cut into runs of RUN windows; the bytes that
   all windows of a run share are counted by digest, and only runs whose core repeats are counted window by
   window. That is exact as well, and linear.
5. Ranges are merged, joined to the texts, and cut out, so that a text gathers its maximal runs and not its segments.

Defined cases: null and empty texts have nothing to remove; texts shorter than ``length`` stay whole; of
repeated rows each counts as an occurrence, so all their windows go; null ids are kept. Very long texts are
worked through in pieces. Only id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mailsift.llm.common import slices, small_batches, written
from mailsift.operators.skew import hot_keys, join_facts

LENGTH = 400
#: Bytes of an anchor at the standard length. A shorter one gives fewer anchors and larger groups.
GRAM = 145
#: Kinds of segment that one task sorts for an anchor, and windows of a run beyond that.
LARGEST, RUN = 4096, 32
#: Window starts worked on at once.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Prefix polynomial hashes modulo 2^64 over random byte values."""

    def __init__(self, n: int):
        self.value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Entry m is the hash of the first m bytes."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:len(data)], out=out[1:])
        return out

    def grams(self, data: np.ndarray, gram: int) -> np.ndarray:
        """Mixed hashes of all pieces of ``gram`` bytes, comparable with one another wherever they start."""
        p = self.prefixes(data)
        x = (p[gram:] - p[:-gram]) * self.down[:len(data) - gram + 1]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each start, the position of the leftmost least value among ``width`` from there on."""
    at, least, reach = np.arange(len(values), dtype=np.int64), values, 1
    while reach < width:
        step = min(reach, width - reach)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.where(later, least[step:], least[:-step])
        reach += step
    return at


def segments_of(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, length: int, gram: int):
    """(first window, windows, anchor position, anchor hash) arrays over texts laid end to end.

    ``bounds`` are the text borders; windows that cross one do not count.
    """
    found = []
    for low in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[low:low + PIECE + length - 1]
        hashes = hasher.grams(part, gram)
        at = leftmost_least(hashes, length - gram + 1)
        valid = np.ones(len(at), bool)
        inner = bounds[(bounds > low) & (bounds < low + len(part))] - low
        for b in inner.tolist():
            valid[max(0, b - length + 1):b] = False
        p = np.flatnonzero(valid)
        if not len(p):
            continue
        a = at[p]
        first = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(p) != 1)))
        last = np.append(first[1:], len(p)) - 1
        found.append((p[first] + low, p[last] - p[first] + 1, a[first] + low, hashes[a[first]]))
    if not found:
        empty = np.array([], np.int64)
        return empty, empty, empty, np.array([], np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


SEGMENTS = "id bigint, tie bigint, anchor bigint, digest binary, start bigint, windows int, lead int"


def segments(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """SEGMENTS rows of texts (id, tie, raw): ``lead`` is the anchor's offset in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE + length)
        for part in slices(batches, "raw"):
            raw = [v or b"" for v in part.column(2).to_pylist()]
            data = b"".join(raw)
            ends = np.cumsum([len(v) for v in raw])
            start, windows, anchor, hashes = segments_of(np.frombuffer(data, np.uint8), ends, hasher, length, gram)
            row = np.searchsorted(ends, start, side="right")
            view = memoryview(data)
            stop = start + windows + (length - 1)
            digests = [_digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist())]
            offset = start - np.append(0, ends)[row]
            taken = pa.array(row)
            columns = [part.column(0).take(taken), part.column(1).take(taken), pa.array(hashes.view(np.int64)),
                       pa.array(digests, pa.binary()), pa.array(offset), pa.array(windows.astype(np.int32)),
                       pa.array((anchor - start).astype(np.int32))]
            for lot in pa.Table.from_arrays(columns, ["id", "tie", "anchor", "digest", "start", "windows", "lead"]).to_batches(20_000):
                yield lot

    return rows.select("id", "tie", "raw").mapInArrow(run, SEGMENTS)


class _Sorted:
    """Suffixes in mergesort order with the common extensions of neighbours."""

    def __init__(self, suffixes: list[bytes], hasher: Hasher):
        self.suffixes = suffixes
        self.prefixes = [hasher.prefixes(np.frombuffer(s, np.uint8)).tolist() for s in suffixes]
        self.order = sorted(range(len(suffixes)), key=functools.cmp_to_key(self._compare))
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[self.order] = np.arange(len(suffixes))
        self.common = np.array([self.extension(a, b) for a, b in zip(self.order, self.order[1:])], np.int64)

    def extension(self, i: int, j: int) -> int:
        """Common bytes of two suffixes: binary search for the longest equal prefix hash, then verified."""
        a, b = self.prefixes[i], self.prefixes[j]
        low, high = 0, min(len(a), len(b)) - 1
        if a[high] == b[high]:
            low = high
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        x, y = self.suffixes[i], self.suffixes[j]
        if x[:low] != y[:low]:
            low = next(m for m, (u, v) in enumerate(zip(x, y)) if u != v)
        return low

    def _compare(self, i: int, j: int) -> int:
        m = self.extension(i, j)
        x, y = self.suffixes[i], self.suffixes[j]
        if m < len(x) and m < len(y):
            return x[m] - y[m]
        return len(x) - len(y)

    def extensions(self, i: int) -> np.ndarray:
        """Common bytes of one suffix with each, by running minima outwards; 0 for itself."""
        at = self.rank[i]
        out = np.zeros(len(self.order), np.int64)
        out[at + 1:] = np.minimum.accumulate(self.common[at:])
        out[:at] = np.minimum.accumulate(self.common[:at][::-1])[::-1]
        return out[self.rank]


def shared_windows(texts: list[bytes], leads: list[int], wanted: list[int], hasher: Hasher,
                   length: int) -> list[tuple[int, int, int]]:
    """(text, first, last): window starts of wanted texts that another text shares, all aligned at their anchors."""
    right = _Sorted([t[lead:] for t, lead in zip(texts, leads)], hasher)
    left = _Sorted([t[:lead][::-1] for t, lead in zip(texts, leads)], hasher)
    out = []
    for i in wanted:
        r, l = right.extensions(i), left.extensions(i)
        near = l + r >= length
        if not near.any():
            continue
        r, l = r[near], l[near]
        if ((r == r.max()) & (l == l.max())).any():
            out.append((i, leads[i] - int(l.max()), leads[i] + int(r.max()) - length))
            continue
        spans = sorted(set(zip((leads[i] - l).tolist(), (leads[i] + r - length).tolist())))
        first, last = spans[0]
        for a, b in spans[1:]:
            if a > last + 1:
                out.append((i, first, last))
                first, last = a, b
            last = max(last, b)
        out.append((i, first, last))
    return out


RANGES = "id bigint, tie bigint, start bigint, stop bigint"


def _sort_groups(length: int):
    """Ranges from rows (anchor, id, tie, start, lead, n, bytes) sorted by anchor; n is how often the kind occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(2 * length + 8)
        schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
        group, anchor, out = [], None, []

        def close() -> None:
            wanted = [i for i, g in enumerate(group) if g[4] == 1]
            if len(group) > 1 and wanted:
                for i, first, last in shared_windows([g[5] for g in group], [g[3] for g in group], wanted, hasher, length):
                    key, tie, start = group[i][:3]
                    out.append((key, tie, start + first, start + last + length))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for name, *row in zip(*columns):
                if name != anchor:
                    close()
                    group, anchor = [], name
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _text_pieces(docs: DataFrame, wanted: DataFrame, extra: list[str]) -> DataFrame:
    """``wanted`` rows (id, tie, start, size and extra columns) with the bytes of their texts.

    Wanted pieces are listed by text, at most as many as the text has windows, and meet it by its key.
    """
    listed = wanted.groupBy(F.coalesce("id", F.lit(0)).alias("id0"), "tie").agg(
        F.collect_set(F.struct("start", "size", *extra)).alias("pieces"))
    met = docs.join(listed.hint("shuffle_hash"), ["id0", "tie"]).select("id", "tie", "raw", F.explode("pieces").alias("w"))
    return met.select("id", "tie", "w.*", F.substring("raw", F.col("w.start").cast("int") + 1, F.col("w.size")).alias("bytes"))


def _counted_runs(docs: DataFrame, kinds: DataFrame, length: int, run_windows: int) -> DataFrame:
    """Ranges of repeated windows among kinds of segments, by digests alone; no group meets in a task.

    First runs of windows whose common core repeats, then, of those, single windows.
    """
    extra = ["anchor", "lead", "n"]
    spans = F.sequence(F.floor((F.col("lead") - F.col("windows") + 1) / run_windows), F.floor(F.col("lead") / run_windows))
    runs = kinds.select("id", "tie", "start", "windows", *extra, F.explode(spans).alias("run")).select(
        "id", "tie", "anchor", "n", "run",
        F.greatest(F.lit(0), F.col("lead") - (F.col("run") + 1) * run_windows + 1).alias("low"),
        F.least(F.col("windows") - 1, F.col("lead") - F.col("run") * run_windows).alias("high"),
        (F.col("lead") - F.col("run") * run_windows).alias("core"), F.col("start").alias("base"), "lead")
    runs = runs.select("id", "tie", "anchor", "n", "run", "base", "lead", "low", "high",
                       (F.col("base") + F.col("core")).cast("bigint").alias("start"),
                       F.lit(length - run_windows + 1).alias("size"))
    named = ["anchor", "n", "run", "base", "lead", "low", "high"]
    cores = _text_pieces(docs, runs, named).withColumn("key", F.xxhash64("anchor", "run", F.sha2("bytes", 256))).drop("bytes")
    cores = written(cores, "cores")
    counts = cores.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n"))
    again = join_facts(cores, counts.where("total > 1").select("key", "total"), "key", hot_keys(counts, "key")).where("total > 1")
    again = written(again, "repeated-cores")
    windows = again.select("id", "tie", "anchor", "n", "lead", "base", F.explode(F.sequence("low", "high")).alias("w")).select(
        "id", "tie", "anchor", "n", (F.col("base") + F.col("w")).cast("bigint").alias("start"),
        F.lit(length).alias("size"), (F.col("lead") - F.col("w")).alias("offset"))
    each = _text_pieces(docs, windows, ["anchor", "n", "offset"]).select(
        "id", "tie", "start", "n", F.xxhash64("anchor", "offset", F.sha2("bytes", 256)).alias("key"))
    each = written(each, "windows")
    counts = each.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n"))
    found = join_facts(each, counts.where("total > 1").select("key", "total"), "key", hot_keys(counts, "key"))
    return found.where("total > 1").select("id", "tie", "start", (F.col("start") + length).alias("stop"))


def _sorted_ranges(pieces: DataFrame, group: str, length: int) -> DataFrame:
    """Ranges that kinds with the same value of ``group`` share, by suffix sort."""
    rows = pieces.select(group, "id", "tie", "start", "lead", "n", "bytes")
    return rows.repartition(group).sortWithinPartitions(group).mapInArrow(_sort_groups(length), RANGES)


def _large_groups(docs: DataFrame, kinds: DataFrame, length: int, gram: int, largest: int, run_windows: int) -> DataFrame:
    """Ranges of kinds whose anchor has more than ``largest``, met by the half of a window right or left of the anchor.

    A kind is in two groups at most. One without so many bytes on a side shares no such half with any other.
    """
    half = (length - gram + 1) // 2
    named = ["anchor", "lead", "n", "windows"]
    pieces = written(_text_pieces(docs, kinds, named), "large")
    right = F.substring("bytes", F.col("lead") + (gram + 1), F.lit(half))
    left = F.when(F.col("lead") >= half, F.substring("bytes", F.col("lead") - (half - 1), F.lit(half)))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), right.alias("half")), F.struct(F.lit(1).alias("side"), left.alias("half"))))
    keyed = pieces.select("id", "tie", "start", *named, sides.alias("s"), "bytes").where(F.octet_length("s.half") == half).select(
        "id", "tie", "start", *named, F.xxhash64("anchor", "s.side", F.sha2("s.half", 256)).alias("key"), "bytes")
    keyed = written(keyed, "halves")
    groups = written(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("single")), "half-groups")
    met = join_facts(keyed, groups.where("n > 1 AND single > 0").select("key", F.col("n").alias("group")), "key", hot_keys(groups, "key"))
    met = written(met, "met-halves")
    ranges = written(_sorted_ranges(met.where(F.col("group") <= largest), "key", length), "half-ranges")
    still = met.where(F.col("group") > largest).select("id", "tie", "start", *named).distinct()
    if still.isEmpty():
        return ranges
    return ranges.unionByName(written(_counted_runs(docs, written(still, "still-large"), length, run_windows), "run-ranges"))


def merged(ranges: DataFrame, text: list[str]) -> DataFrame:
    """The maximal runs of each text's ranges (start, stop); repeated ranges are dropped before they are shuffled."""
    distinct = ranges.groupBy(*text, "start").agg(F.max("stop").alias("stop"))
    inner = Window.partitionBy(*text).orderBy("start")
    seen = F.max("stop").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    marked = distinct.withColumn("opens", (F.coalesce(seen, F.lit(-1)) < F.col("start")).cast("int"))
    runs = marked.withColumn("run", F.sum("opens").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*text, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _cut(length: int):
    """Texts without their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "raw"):
            n, gone, runs, kept = [], [], [], []
            for raw, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = raw or b""
                at, pieces, count = 0, [], 0
                stop = -1
                for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if a > stop:
                        pieces.append(raw[max(at, 0):a])
                        count += 1
                    stop = max(stop, b)
                    at = stop
                pieces.append(raw[at:])
                whole = b"".join(pieces)
                n.append(len(raw))
                gone.append(len(raw) - len(whole))
                runs.append(count)
                kept.append(whole)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in (n, gone, runs)], pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None,
                   largest: int = LARGEST, run_windows: int = RUN) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the remaining bytes."""
    gram = gram or max(1, GRAM * length // LENGTH)
    run_windows = min(run_windows, length // 2 or 1)
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("_text")).select(
        "id", F.coalesce("id", F.lit(0)).alias("id0"), F.xxhash64("id", "_text").alias("tie"),
        F.coalesce(F.col("_text").cast("binary"), F.lit(b"")).alias("raw"))
    found = written(segments(docs, length, gram), "segments")
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    anchors = written(anchors.where("n > 1").select("anchor", "n", (F.col("a") != F.col("b")).alias("mixed")), "anchors")
    met = join_facts(found, anchors.select("anchor", "mixed"), "anchor", hot_keys(anchors, "anchor")).where("mixed IS NOT NULL")
    met = written(met, "repeated")
    mixed = met.where("mixed")
    kinds = mixed.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tie", "start", "windows", "lead")).alias("one")).select(
        "anchor", "digest", "n", "one.*")
    kinds = written(kinds, "kinds")
    per_anchor = written(kinds.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n") == 1, 1)).alias("single")), "groups")
    sized = join_facts(kinds, per_anchor.select("anchor", F.col("n").alias("group"), "single"), "anchor",
                       hot_keys(per_anchor, "anchor")).where("single > 0")
    sized = written(sized.withColumn("size", F.col("windows") + (length - 1)), "sized")
    whole = F.col("start") + F.col("windows") + (length - 1)
    equal = met.where("NOT mixed").select("id", "tie", "start", whole.alias("stop"))
    copies = join_facts(mixed, kinds.where("n > 1").select("digest", "n"), "digest", hot_keys(kinds, "digest")).where(
        "n > 1").select("id", "tie", "start", whole.alias("stop"))
    covered = written(equal.unionByName(copies), "covered")
    pieces = _text_pieces(docs, sized.where(F.col("group") <= largest), ["anchor", "lead", "n"])
    ranges = covered.unionByName(_sorted_ranges(pieces, "anchor", length))
    many = sized.where(F.col("group") > largest)
    if not many.isEmpty():
        ranges = ranges.unionByName(_large_groups(docs, many, length, gram, largest, run_windows))
    listed = merged(ranges.select(F.coalesce("id", F.lit(0)).alias("id0"), "tie", "start", "stop"), ["id0", "tie"]).groupBy(
        "id0", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = docs.join(listed.hint("shuffle_hash"), ["id0", "tie"], "left").select("id", "raw", "spans").mapInArrow(
        _cut(length), "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return cut.withColumnRenamed("id", key)

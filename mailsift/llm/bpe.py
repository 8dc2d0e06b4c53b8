"""Byte-level BPE: encoding by a minimal perfect hash and a heap over linked bytes, and decoding.

A text is cut into pre-tokens by the tokenizer's pattern. A pre-token that is itself in the vocabulary
is found by a minimal perfect hash: one hash of its bytes, one displacement, one comparison with the key
in the slot. Only the others are merged: their bytes form a linked list, and a heap holds the ranks of
neighbouring pairs, so a pre-token of n bytes costs n log n however long it is.

Encoding is row by row, so no key can be hot and nothing is shuffled. The vocabulary has a fixed size
and travels as a broadcast variable.

Defined cases: a null or empty text has no tokens and decodes to nothing; equal texts have equal ids.
Only the id and text columns are read; further columns, whatever their names, are not touched.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from mailsift.llm.common import slices, small_batches, texts

#: Pre-tokens whose ids a task remembers, and the longest one it remembers.
REMEMBERED, LONGEST = 400_000, 64
_START = (1 << 40) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def compiled(pattern: str, most: int = sys.maxunicode) -> re.Pattern:
    r"""The pattern for Python's own, faster engine: ``\p{..}``, ``\s`` and ``\S`` become the ranges of
    code points up to ``most`` that the ``regex`` module has for them."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = regex.match(r"\\p\{\w+\}|\\[sS]", pattern, pos=at)
        if found:
            name = found[0].replace("S", "s") if found[0] == r"\S" else found[0]
            ranges = _ranges(name, most)
            if found[0] == r"\S" and inside:
                raise ValueError(r"\S within a class is not supported")
            out.append(ranges if inside else f"[{'^' * (found[0] == chr(92) + 'S')}{ranges}]")
            at = found.end()
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at:at + step])
        at += step
    return re.compile("".join(out))


def _ranges(name: str, most: int) -> str:
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, most + 1))))
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in regex.findall(f"(?:{name})+", every))


class PerfectHash:
    """Hash and displace: buckets of keys, largest first, each get the displacement that fills free slots.

    A bucket of one key stores its slot itself. There are as many slots as keys.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = n // 2 + 1
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) != len(hashes):
            raise ValueError("the keys must be distinct")
        groups: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(h % self.buckets, []).append(i)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.order = np.full(n, -1, dtype=np.int64)
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                break
            d = 0
            while True:
                found = [self._slot(hashes[i], d) for i in members]
                if len(set(found)) == len(found) and all(self.order[s] < 0 for s in found):
                    break
                d += 1
            self.shift[bucket] = d
            self.order[found] = members
        free = iter(np.flatnonzero(self.order < 0))
        for bucket, members in sorted(groups.items()):
            if len(members) == 1:
                slot = int(next(free))
                self.shift[bucket] = -slot - 1
                self.order[slot] = members[0]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = int(self.shift[h % self.buckets])
        return -d - 1 if d < 0 else self._slot(h, d)


class Vocabulary:
    """Ranks, their perfect hash in slot order, and the bytes of every id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.order] if keys else []
        self.pattern_of = {False: compiled(pattern, 0xFFFF), True: compiled(pattern)}
        self.bytes_of = {r: k for k, r in ranks.items()}
        self.seen: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: bytes) -> int | None:
        """The id of a piece that is in the vocabulary."""
        if not self.keys:
            return None
        slot = self.hash.slot(piece)
        return self.ranks[piece] if self.keys[slot] == piece else None

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by merging the neighbours of least rank, leftmost first, until none can merge."""
        ranks, n = self.ranks, len(piece)
        get = ranks.get
        # A part starts at i and ends at end[i], where the next one starts; pair[i] is the rank of both together.
        end, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(piece[i:i + 2]) for i in range(n - 1)]
        pair.append(None)
        heap = [r << 40 | i for i, r in enumerate(pair) if r is not None]
        heapq.heapify(heap)
        while heap:
            least = heapq.heappop(heap)
            i = least & _START
            if pair[i] != least >> 40:
                continue
            j = end[i]
            stop = end[i] = end[j]
            pair[i] = pair[j] = None
            if stop < n:
                before[stop] = i
                if (r := get(piece[i:end[stop]])) is not None:
                    pair[i] = r
                    heapq.heappush(heap, r << 40 | i)
            k = before[i]
            if k >= 0:
                pair[k] = r = get(piece[k:stop])
                if r is not None:
                    heapq.heappush(heap, r << 40 | k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def ids_of(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        found = self.whole(raw)
        return (found,) if found is not None else self.merged(raw)

    def encode(self, text: str) -> np.ndarray:
        # The engine tests classes by a table up to code point FFFF and by a list of ranges beyond it.
        beyond = len(text.encode("utf-16-le")) > 2 * len(text)
        pieces = self.pattern_of[beyond].findall(text)
        seen = self.seen
        for p in set(pieces).difference(seen):
            seen[p] = self.ids_of(p)
        ids = np.fromiter(chain.from_iterable(map(seen.__getitem__, pieces)), dtype="<u4")
        if len(seen) > REMEMBERED:
            seen.clear()
        elif pieces and (most := max(map(len, pieces))) > LONGEST:
            for p in [p for p in set(pieces) if len(p) > LONGEST]:
                del seen[p]
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_built: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """Read and hashed once on the driver, then broadcast; its size is that of the vocabulary file."""
    if (path, pattern) not in _built:
        _built[path, pattern] = Vocabulary(read_ranks(path), pattern)
    return spark.sparkContext.broadcast(_built[path, pattern])


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """(key, n_tokens, ids) with the ids packed as little-endian unsigned 32-bit numbers.

    With ``decoded`` a column of that name holds the bytes that the packed ids decode to.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = vocabulary(spark, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for part in slices(batches, "_text"):
            packed = [vocab.encode(t) for t in texts(part.column(1))]
            columns = [part.column(0), pa.array([len(p) for p in packed], pa.int64()),
                       pa.array([p.tobytes() for p in packed], pa.binary())]
            if decoded:
                columns.append(pa.array([vocab.decode(p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, ids binary" + (", decoded binary" if decoded else "")
    names = [key, "n_tokens", "ids"] + ["decoded"] * decoded
    return df.selectExpr(f"`{key}` AS _key", f"`{text}` AS _text").mapInArrow(run, schema)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): the bytes of packed ids; null ids decode to nothing."""
    spark = df.sparkSession
    small_batches(spark)
    shared = vocabulary(spark, path, "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value.bytes_of
        for batch in batches:
            out = [b"".join(bytes_of[i] for i in np.frombuffer(v or b"", "<u4").tolist())
                   for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS _key", f"`{ids}` AS _ids").mapInArrow(run, f"`{key}` {kind}, decoded binary")

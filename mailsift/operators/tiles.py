"""Blocks of queries against a stream of points.

Each point asks in one task only. A task holds its block of queries and what is known of them, the other points come
by as packed chunks, one at a time: neither pairs nor partial results are shuffled, and no task holds more than a
block and a few chunks. Chunks are points of one part, so a ball around a chunk tells which queries it concerns.
The points are shuffled once for each block of queries; blocks grow with the table up to TASK_BYTES.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TASK_BYTES = 16 << 20  # of queries and what is known of them that a task holds
TILE = 512             # queries whose distances to a chunk are held at once
BLOCKS_A_CORE = 3
NEST = 256             # points of a chunk that lie together and are ruled out together
FLAT = 24              # numbers a point has at most if boxes, not balls, rule them out
ROWS_OUT = 8192

PACKED = "block int, place int, payload binary"
QUERIES, OWN, OTHER = range(3)


class Rows:
    """Columns of a packed table as numpy arrays, ``x`` and other arrays as matrices."""

    def __init__(self, table: pa.Table):
        self.size = table.num_rows
        for name in table.column_names:
            setattr(self, name, _numpy(table.column(name).combine_chunks()))


def _numpy(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if pa.types.is_list(column.type):
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and not (sizes == sizes[0]).all():
            raise ValueError("points have null coordinates or different numbers of them")
        values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if pa.types.is_int64(column.type) and column.null_count:
        column = column.fill_null(np.iinfo(np.int64).min)
    return column.to_numpy(zero_copy_only=False)


def layout(rows: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block of each part, blocks of each part, all blocks), of about ``size`` rows; small parts share a block."""
    first, count = (np.full(max(rows, default=0) + 1, v, dtype=np.int64) for v in (0, 1))
    at, room = 0, size
    for part in sorted(rows):
        n = rows[part]
        if n > size:
            at += room < size
            first[part], count[part] = at, math.ceil(n / size)
            at, room = at + count[part], size
        else:
            at, room = (at, room) if n <= room else (at + 1, size)
            first[part], room = at, room - n
    return first, count, int(at + (room < size))


def _dealt(pid: np.ndarray, part: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Block of each point: that of its part, one of several by a hash of the point."""
    mixed = (pid.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return first[part] + (mixed % count[part].astype(np.uint64)).astype(np.int64)


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def stream(queries: DataFrame, home: DataFrame, query_rows: dict[int, int], home_rows: dict[int, int],
           fold: Callable[[Rows], tuple[Callable, Callable]], schema: str, block: int, row_bytes: int) -> DataFrame:
    """Run ``fold`` for every block of queries over all chunks of home points.

    Both tables have ``pid`` and ``part``; the rows of each part are known. ``fold(queries)`` returns (step, finish): ``step(chunk)`` takes
    in one chunk of ``block`` points, ``finish()`` gives the block's result; both yield Arrow batches of ``schema``. A block's
    own parts come first. ``row_bytes`` is what a task holds for one query.
    """
    spark = queries.sparkSession
    n, cores = sum(query_rows.values()), spark.sparkContext.defaultParallelism
    if not n or not home_rows:
        return spark.createDataFrame([], schema)
    size = max(min(block, TILE), min(math.ceil(n / (BLOCKS_A_CORE * cores)), TASK_BYTES // row_bytes))
    first, count, blocks = layout(query_rows, size)
    chunk_first, chunk_count, _ = layout(home_rows, block)
    # Chunks hold one part each: parts that share a block above are told apart here.
    known = np.array(sorted(home_rows))
    chunk_first = np.zeros_like(chunk_first)
    chunk_first[known] = np.cumsum(np.r_[0, chunk_count[known][:-1]])

    def own(part: int) -> tuple[int, int]:
        return (int(first[part]), int(count[part])) if part in query_rows else (-1, 0)

    def pack_queries(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = _dealt(_numpy(batch.column("pid")), _numpy(batch.column("part")), first, count)
            order = np.argsort(at, kind="stable")
            for lot in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(lot):
                    payload = _bytes(pa.Table.from_batches([batch.take(pa.array(lot))]))
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([at[lot[0]]], pa.int32()), "place": pa.array([QUERIES], pa.int32()), "payload": pa.array([payload], pa.binary())})

    def numbered(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            at = _dealt(_numpy(batch.column("pid")), _numpy(batch.column("part")), chunk_first, chunk_count)
            yield batch.append_column("chunk", pa.array(at, pa.int64()))

    def pack_home(batches: Iterator[pa.RecordBatch]):
        def packed():
            table = pa.Table.from_batches(held)
            low, many = own(table.column("part")[0].as_py())
            return pa.RecordBatch.from_pydict({
                "low": pa.array([low], pa.int32()), "many": pa.array([many], pa.int32()),
                "payload": pa.array([_bytes(table.drop_columns(["chunk"]).take(pa.array(nested(_numpy(table.column("x"))))))], pa.binary())})
        held, now = [], None
        for batch in batches:
            at = _numpy(batch.column("chunk"))
            cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and at[a] != now:
                    yield packed()
                    held = []
                held.append(batch.slice(a, b - a))
                now = at[a]
        if held:
            yield packed()

    def run(batches: Iterator[pa.RecordBatch]):
        now, asked, step, finish = None, [], None, None
        for batch in batches:
            for at, place, payload in zip(*(batch.column(c) for c in ("block", "place", "payload"))):
                at = at.as_py()
                if at != now:
                    if asked:
                        if step is None:
                            step, finish = fold(Rows(pa.concat_tables(asked)))
                        yield from finish()
                    now, asked, step = at, [], None
                table = pa.ipc.open_stream(payload.as_buffer()).read_all()
                if place.as_py() == QUERIES:
                    asked.append(table)
                elif asked:
                    if step is None:
                        step, finish = fold(Rows(pa.concat_tables(asked)))
                    yield from step(Rows(table))
        if asked:
            if step is None:
                step, finish = fold(Rows(pa.concat_tables(asked)))
            yield from finish()

    kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    by_chunk = home.mapInArrow(numbered, f"{kinds(home)}, chunk bigint").repartition("chunk").sortWithinPartitions("chunk")
    chunks = by_chunk.mapInArrow(pack_home, "low int, many int, payload binary")
    at = F.col("block")
    sent = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "block", F.when((at >= F.col("low")) & (at < F.col("low") + F.col("many")), OWN).otherwise(OTHER).alias("place"), "payload")
    asked = queries.mapInArrow(pack_queries, PACKED)
    return asked.unionByName(sent).repartitionById(blocks, at).sortWithinPartitions("block", "place").mapInArrow(run, schema)


def nested(x: np.ndarray) -> np.ndarray:
    """An order of the points in which each NEST of them lie together: cut at medians across the widest side."""
    def cut(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= NEST:
            return [rows]
        part, half = x[rows], -(-len(rows) // (2 * NEST)) * NEST  # all but the last are full
        with np.errstate(all="ignore"):
            side = np.nan_to_num(part.max(axis=0) - part.min(axis=0), nan=-1.0).argmax()
        order = np.argpartition(part[:, side], min(half, len(rows) - 1))
        return cut(rows[order[:half]]) + cut(rows[order[half:]])
    return np.concatenate(cut(np.arange(len(x))))


def nests(h: Rows) -> Iterator[slice]:
    for start in range(0, h.size, NEST):
        yield slice(start, min(start + NEST, h.size))


def least_apart(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """No point of ``x`` is closer to a point of ``a`` than this; NaN where that is not known."""
    if x.shape[1] > FLAT:
        middle, radius = ball(x)
        return apart(a, middle) - radius
    low, high = x.min(axis=0), x.max(axis=0)
    total = np.zeros(len(a))
    for k in range(x.shape[1]):
        v = a[:, k]
        gap = np.maximum(low[k] - v, v - high[k])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        total += gap
    return np.sqrt(total)


def tiles(rows: np.ndarray) -> Iterator[np.ndarray]:
    for start in range(0, len(rows), TILE):
        yield rows[start:start + TILE]


def ball(x: np.ndarray, radius: np.ndarray | float = 0.0) -> tuple[np.ndarray, float]:
    """Middle and radius of a ball around the points, or around balls with ``radius``."""
    middle = x.mean(axis=0)
    return middle, float((np.sqrt(((x - middle) ** 2).sum(axis=1)) + radius).max())


def apart(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - middle) ** 2).sum(axis=1))


def batches_of(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for start in range(0, whole.num_rows, ROWS_OUT):
        yield whole.slice(start, ROWS_OUT)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)

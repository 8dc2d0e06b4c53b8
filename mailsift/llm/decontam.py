"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark. Their document frequencies are counted over all whole documents.
2. Passages of all distinct documents, and the benchmark items, are TF-IDF rows of a matrix. A
   randomised SVD gives its leading right singular vectors: tasks multiply their rows with a thin random
   matrix and back, the small products are summed, and the basis is made orthonormal, a few times over.
3. Search. Every document is walked in windows a little longer than an item, STEP words apart. A window is projected,
   and an item whose cosine reaches COSINE is a candidate. Windows that cannot pass the check are left out first, and no
   others: of the item's words at most the rest beyond SHARE may be missing, so of any that many and ``c`` more, here
   the heaviest, ``c`` must stand in the region. An inverted index of these words finds the regions that hold ``c``.
4. Check. A candidate is a leak if the longest common subsequence of the item's words and the region around
   the window has at least SHARE of the item's words. Where an answer column is named and the item's answer
   has words, at least ANSWER of these must be in the region as well; without one the share alone decides, so
   an item cut at either end is found alike.
5. Items of fewer than SHORT words must be there entirely and in one piece. Few words weigh too little against
   their neighbours in a window, so these are looked for word by word instead, at every word of every document,
   by one walk through a trie of all of them; their cosine and share are 1.

The benchmark is worked through in blocks of about ``block`` items, so what is broadcast has a bound; each
block turns the words of the documents into term numbers once, which are stored; to count, to list the terms of
passages and to search reads those. Of the documents only the lists are shuffled, copies combined before, so copies and hot items cost what they cost alone.

Defined cases: null and empty texts leak nothing; null, empty and wordless items match nothing; equal
items are each reported; repeated documents are each reported; an empty benchmark gives no rows; the answer
share of an item without an answer is null. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mailsift.llm.common import schema_with, slices, small_batches, texts, written

SHARE, ANSWER, SHORT = 0.7, 0.5, 8
COSINE, STEP = 0.6, 4
#: Dimensions of the latent space and spare ones of the range finder, and its rounds.
RANK, SPARE, ROUNDS = 48, 16, 2
#: Words of a passage, and items of a block.
PASSAGE, BLOCK = 48, 2000
#: Terms whose columns are dense, and words that a task holds at once; a single longer text makes a lot of its own.
FREQUENT, SLICE_WORDS = 512, 400_000
_WORD = re.compile(r"\w+")
_ASCII = {i: chr(i).lower() if _WORD.match(chr(i)) else " " for i in range(128)}


def words(text: str) -> list[str]:
    """Lower-case words; of a plain ASCII text without a search for each."""
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


@dataclass
class Item:
    id: int
    terms: list[int]
    answer: list[int]


@dataclass
class Index:
    """Items, the vocabulary, its weights and its latent vectors (weight times singular vector)."""

    items: list[Item]
    term: dict[str, int]
    weight: np.ndarray
    latent: np.ndarray

    def __post_init__(self):
        #: Trie of the short items: (node, term) as one number to the next node, and the items that end in a node.
        edges: dict[int, int] = {}
        self.ending: dict[int, list[int]] = {}
        #: Of the other items: words of a window and beside it, telling words that a region must hold, and which these are.
        n = len(self.items)
        self.size, self.spare, self.least = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
        telling: list[tuple[int, int]] = []
        for i, item in enumerate(self.items):
            m = len(item.terms)
            if m < SHORT:
                node = 0
                for t in item.terms:
                    node = edges.setdefault(node * len(self.weight) + t, len(edges) + 1)
                self.ending.setdefault(node, []).append(i)
            else:
                self.size[i] = -(-m // STEP) * STEP + STEP
                self.spare[i] = max(STEP, m // 4)
                self.least[i] = m // 4
                missing = m - math.ceil(SHARE * m - 1e-9)
                heavy = sorted(item.terms, key=lambda t: (-self.weight[t], t))[:missing + m // 4]
                telling += [(t, i) for t in set(heavy)]
        telling.sort()
        self.told = np.array([i for _, i in telling], np.int64)
        self.told_from = np.searchsorted([t for t, _ in telling], np.arange(len(self.weight) + 1))
        self.edges = np.array(sorted(edges.items()), np.int64).reshape(-1, 2)
        vectors = np.array([self.latent[x.terms].sum(axis=0) for x in self.items]).reshape(len(self.items), -1)
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a`` at a time."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        m = masks.get(w, 0)
        hit = row & m
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _short(index: Index, ids: np.ndarray, ends: np.ndarray, document: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, item, first words) of the short items that stand in a text word for word; of an item without an
    answer only the first place."""
    at = np.arange(len(ids)) if len(index.edges) else np.zeros(0, np.int64)
    node = np.zeros(len(at), np.int64)
    keys, nodes = index.edges.T
    for depth in range(SHORT - 1):
        inside = at + depth < ends[document[at]]
        at, node = at[inside], node[inside]
        following = ids[at + depth]
        key = node * len(index.weight) + following
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        on = np.flatnonzero((following >= 0) & (keys[slot] == key))
        at, node = at[on], nodes[slot[on]]
        if not len(at):
            return
        order = np.argsort(node, kind="stable")
        reached, start = np.unique(node[order], return_index=True)
        for n, places in zip(reached.tolist(), np.split(at[order], start[1:])):
            if n not in index.ending:
                continue
            docs, start = np.unique(document[places], return_index=True)
            for doc, group in zip(docs.tolist(), np.split(places, start[1:])):
                for i in index.ending[n]:
                    yield doc, i, group if index.items[i].answer else group[:1]


def _regions(index: Index, ids: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, last place) of the runs of telling words that lie within a region of their item."""
    at = np.flatnonzero(ids >= 0)
    low, high = index.told_from[ids[at]], index.told_from[ids[at] + 1]
    times = high - low
    place = np.repeat(at, times)
    item = index.told[np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(len(place))]
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    end = np.arange(len(item)) + index.least[item] - 1
    inside = np.flatnonzero(end < len(item))
    end = end[inside]
    wide = index.size[item[inside]] + 2 * index.spare[item[inside]]
    held = (item[end] == item[inside]) & (document[place[end]] == document[place[inside]]) & (place[end] - place[inside] < wide)
    return item[inside][held], place[inside][held], place[end][held]


def _near(index: Index, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray,
          document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, cosine, first word) of the windows near an item."""
    item, first, last = _regions(index, ids, document)
    # All windows, STEP words apart, whose region holds the run.
    doc = document[first] if len(first) else first
    low = np.maximum(last - index.size[item] - index.spare[item] + 1 - begins[doc], 0)
    low = -(-low // STEP)
    high = np.minimum(first + index.spare[item], ends[doc] - 1) - begins[doc]
    high = high // STEP
    times = np.maximum(high - low + 1, 0)
    step = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(int(times.sum()))
    top = int(step.max(initial=0)) + 1
    key = np.unique((np.repeat(doc, times) * len(index.items) + np.repeat(item, times)) * top + step)
    step, pair = key % top, key // top
    doc, item = pair // len(index.items), pair % len(index.items)
    # Window sums are differences of running totals over whole steps of the documents that have such windows.
    some, of = np.unique(doc, return_inverse=True)
    steps = -(-(ends[some] - begins[some]) // STEP)
    start = np.append(0, np.cumsum(steps)[:-1]).astype(np.int64)
    own = np.repeat(np.arange(len(some)), steps)
    spot = (begins[some][own] + (np.arange(int(steps.sum())) - start[own]) * STEP)[:, None] + np.arange(STEP)
    words_ = np.where(spot < ends[some][own][:, None], ids[np.minimum(spot, max(len(ids) - 1, 0))], -1) if len(own) else np.zeros((0, STEP), np.int64)
    latent = np.vstack((index.latent, np.zeros((1, index.latent.shape[1]), index.latent.dtype)))
    upto = np.zeros((len(words_) + 1, latent.shape[1]))
    np.cumsum(sum(latent[words_[:, i]] for i in range(STEP)), axis=0, dtype=np.float64, out=upto[1:])
    at = start[of] + step if len(of) else step
    stop = np.minimum(at + index.size[item] // STEP, (start + steps)[of]) if len(of) else at
    cosine = np.zeros(len(at))
    for lot in np.array_split(np.arange(len(at)), max(1, len(at) // 20_000)):
        vectors = upto[stop[lot]] - upto[at[lot]]
        length = np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)
        cosine[lot] = np.einsum("ij,ij->i", vectors, index.vectors[item[lot]]) / length
    near = cosine >= COSINE
    return doc[near], item[near], cosine[near], (begins[doc] + step * STEP)[near]


def find(index: Index, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float | None]]:
    """(document, item, first word, cosine, subsequence share, answer share) of the leaks in texts given as term
    numbers end to end (-1: no term), one for each pair."""
    begins = np.append(0, ends[:-1])
    document = np.repeat(np.arange(len(ends)), ends - begins)
    hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    for doc, i, cosine, a in zip(*(x.tolist() for x in _near(index, ids, begins, ends, document))):
        hits.setdefault((doc, i), []).append((-cosine, a, min(a + int(index.size[i]), int(ends[doc]))))
    exact = {(doc, i): places for doc, i, places in _short(index, ids, ends, document)}
    for doc, i in sorted([*hits, *exact]):
        item = index.items[i]
        if (doc, i) in exact:
            spare, windows = 4 * STEP, ((-1.0, int(a), int(a) + len(item.terms)) for a in exact[doc, i])
        else:
            spare, windows = int(index.spare[i]), sorted(hits[doc, i])
        for cosine, a, b in windows:
            region = ids[max(begins[doc], a - spare):min(ends[doc], b + spare)].tolist()
            share = common_subsequence(item.terms, region) / len(item.terms)
            answer = common_subsequence(item.answer, region) / len(item.answer) if item.answer else None
            if share >= SHARE and (answer is None or answer >= ANSWER):
                yield doc, item.id, int(a - begins[doc]), -cosine, share, answer
                break


def _ids(column: pa.Array, term: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    found = [words(t) for t in texts(column)]
    ends = np.cumsum([len(x) for x in found]).astype(np.int64)
    numbers = map(term.get, chain.from_iterable(found), repeat(-1))
    return np.fromiter(numbers, np.int64, int(ends[-1]) if len(ends) else 0), ends


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all lists end to end, and where each list ends."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes).astype(np.int64)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut where the first column's lists reach SLICE_WORDS numbers."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pa.compute.list_value_length(batch.column(0)).to_pylist()):
            if held and held + size > SLICE_WORDS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _coded(df: DataFrame, term: dict[str, int], keep: list[str], text: str = "text") -> DataFrame:
    """``_ids`` (term numbers of a text's words, -1: no term), ``_digest``, ``_draw`` and the kept columns."""
    shared = df.sparkSession.sparkContext.broadcast(term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            ids, ends = _ids(part.column(0), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, *part.columns[1:]], ["_ids", "_digest", "_draw", *keep])

    whole = F.col(f"`{text}`")
    rows = df.select(whole.alias("_text"), F.md5(F.coalesce(whole, F.lit(""))).alias("_digest"),
                     F.pmod(F.xxhash64(whole), F.lit(1_000_000)).alias("_draw"), *[F.col(f"`{k}`") for k in keep])
    kind = T.StructType([T.StructField("_ids", T.ArrayType(T.IntegerType())), *(rows.schema[c] for c in ["_digest", "_draw", *keep])])
    return rows.mapInArrow(run, kind)


def _weights(coded: DataFrame, term: dict[str, int]) -> np.ndarray:
    """Inverse document frequencies of the terms over all documents."""
    size = len(term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size + 1, np.int64)
        for part in _lots(batches):
            ids, ends = _lists(part.column(0))
            owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
            pairs = np.unique(owner * (size + 1) + ids + 1)
            counts += np.bincount(pairs % (size + 1), minlength=size + 1)
        seen = np.flatnonzero(counts[1:])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1:][seen])], ["term", "n"])

    total = coded.count()
    rows = coded.select("_ids").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size)
    for r in rows:
        df[r.term] = r.n
    return np.log((total + 2) / (df + 1)).astype(np.float32)


def frequent(weight: np.ndarray) -> np.ndarray:
    """For each term its place among the FREQUENT terms of least weight, -1 for the others."""
    place = np.full(len(weight), -1, np.int64)
    terms = np.argsort(weight, kind="stable")[:FREQUENT]
    place[terms] = np.arange(len(terms))
    return place


def _through(flat: np.ndarray, starts: np.ndarray, weight: np.ndarray, basis: np.ndarray, scale: float, out: np.ndarray,
             place: np.ndarray | None = None) -> None:
    """Adds to ``out`` the TF-IDF rows transposed times the rows times the basis; rows are brought to length ``scale``.

    ``flat`` holds the terms of all rows, ``starts`` where each begins. Most words of a row are among a few
    frequent terms (:func:`frequent`): these columns are a dense matrix, of the others only terms that are there cost anything.
    """
    place = frequent(weight) if place is None else place
    common = np.flatnonzero(place >= 0)
    common = common[np.argsort(place[common])]
    n, width = len(starts), len(common)
    row = np.repeat(np.arange(n), np.diff(np.append(starts, len(flat))))
    at = place[flat]
    dense = at >= 0
    often = np.bincount(row[dense] * width + at[dense], minlength=n * width).reshape(n, width).astype(np.float32) * weight[common]
    cell, count = np.unique(row[~dense] * len(weight) + flat[~dense], return_counts=True)
    row, col = np.divmod(cell, len(weight))
    value = (count * weight[col]).astype(np.float32)
    length = np.sqrt(np.einsum("ij,ij->i", often, often) + np.bincount(row, value * value, n))
    factor = (scale / np.maximum(length, 1e-12)).astype(np.float32)
    often *= factor[:, None]
    value *= factor[row]
    ahead = often @ basis[common]
    if len(cell):
        rows, first = np.unique(row, return_index=True)
        ahead[rows] += np.add.reduceat(value[:, None] * basis[col], first)
        by_term = np.argsort(col, kind="stable")
        terms, first = np.unique(col[by_term], return_index=True)
        out[terms] += np.add.reduceat(value[by_term, None] * ahead[row[by_term]], first)
    out[common] += often.T @ ahead


def _passages(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each document its passages, lists of the terms among PASSAGE words, those without terms left out."""
    begins = np.append(0, ends[:-1])
    held = -(-(ends - begins) // PASSAGE)
    base = np.cumsum(held) - held
    owner = np.repeat(np.arange(len(ends)), ends - begins)
    passage = base[owner] + (np.arange(len(ids)) - begins[owner]) // PASSAGE
    told = np.flatnonzero(ids >= 0)
    first = np.flatnonzero(np.append(True, np.diff(passage[told]) != 0)) if len(told) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(told)), pa.int32()), pa.array(ids[told], pa.int32()))
    outer = np.append(0, np.cumsum(np.bincount(owner[told[first]], minlength=len(ends))))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)


def _latent(docs: DataFrame, items: list[Item], term: dict[str, int], weight: np.ndarray, sample: int | None = None) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF rows, by a distributed randomised range finder.

    The rows are the passages of all distinct documents, or of about ``sample`` of them where a caller asks for fewer.
    """
    spark = docs.sparkSession
    drawn = docs if "_ids" in docs.columns else _coded(docs, term, [])
    if sample is not None:  # copies are drawn all or none
        drawn = drawn.where(F.col("_draw") < math.ceil(1_000_000 * min(1.0, sample / max(1, docs.count()))))

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _lots(batches):
            yield pa.RecordBatch.from_arrays([part.column(1), _passages(*_lists(part.column(0)))], ["digest", "rows"])

    # Copies are made one once their texts have become short lists.
    told = drawn.select("_ids", "_digest").mapInArrow(
        passages, "digest string, rows array<array<int>>").where(F.size("rows") > 0).distinct()
    rows = written(told.select(F.explode("rows").alias("terms")), "passages")
    n = rows.count()
    heavy = math.sqrt(max(1, n) / len(items))
    weight = weight.astype(np.float32)
    place = frequent(weight)

    def through(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape, np.float64)
            for batch in batches:
                flat, ends = _lists(batch.column(0))
                if len(flat):
                    _through(flat, np.append(0, ends[:-1]), weight, shared.value, 1.0, total, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["term", "part"])

        # Tasks' sums meet by term; the driver has one thin matrix, however many tasks there are.
        width = basis.shape[1]
        parts = rows.mapInArrow(run, "term int, part array<double>").groupBy("term").agg(
            F.array(*[F.sum(F.col("part")[i]) for i in range(width)]).alias("part")).collect()
        shared.destroy()
        total = np.zeros(basis.shape)
        for r in parts:
            total[r.term] = r.part
        for i in range(0, len(items), 200):
            lists = [x.terms for x in items[i:i + 200] if x.terms]
            if lists:
                ends = np.cumsum([len(x) for x in lists])
                flat = np.fromiter(chain.from_iterable(lists), np.int64, ends[-1])
                _through(flat, np.append(0, ends[:-1]), weight, basis, heavy, total, place)
        return total

    width = min(len(term), RANK + SPARE)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(term), width)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(through(basis))[0].astype(np.float32)
    values, turn = np.linalg.eigh(basis.T.astype(np.float64) @ through(basis))
    return (basis @ turn[:, ::-1][:, :min(RANK, width)]).astype(np.float32)


def build_index(docs: DataFrame, rows: list, sample: int | None = None) -> Index | None:
    """The index of items (id, text, answer or None) under the statistics of all documents (column text)."""
    return _indexed(docs, rows, [], sample=sample)[0]


def _indexed(docs: DataFrame, rows: list, keep: list[str], text: str = "text",
             sample: int | None = None) -> tuple[Index | None, DataFrame | None]:
    """The index, and the documents as term numbers with their kept columns."""
    split = [(r[0], words(r[1] or ""), words(r[2] or "")) for r in rows]
    split = sorted((i, w, a) for i, w, a in split if w)
    term: dict[str, int] = {}
    for _, w, a in split:
        for x in w + a:
            term.setdefault(x, len(term))
    if not term:
        return None, None
    items = [Item(i, [term[x] for x in w], [term[x] for x in a]) for i, w, a in split]
    coded = _coded(docs, term, keep, text)
    if sample is None:  # of a sample only the passages are stored
        coded = written(coded, "coded")
    weight = _weights(coded, term)
    basis = _latent(coded, items, term, weight, sample)
    return Index(items, term, weight, basis * weight[:, None]), coded


LEAK = "item_id bigint, word bigint, cosine double, share double, answer_share double"
LEAKS = "array<struct<item_id:bigint,word:bigint,cosine:double,share:double,answer_share:double>>"


def _found(index: Index, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """For each text the list of its leaks."""
    fields = [("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()),
              ("answer_share", pa.float64())]
    found: list[list[dict]] = [[] for _ in range(len(ends))]
    for doc, *leak in find(index, ids, ends):
        found[doc].append(dict(zip([f[0] for f in fields], leak)))
    return pa.array(found, pa.list_(pa.struct(fields)))


def _search(df: DataFrame, index: Index, keep: list[str], text: str) -> DataFrame:
    """The kept columns and ``leaks``, an array of LEAK, row by row."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            leaks = _found(shared.value, *_ids(part.column(0), shared.value.term))
            yield pa.RecordBatch.from_arrays([*part.columns[1:], leaks], [*keep, "leaks"])

    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{k}`") for k in keep])
    return rows.mapInArrow(run, schema_with(df, keep, leaks=LEAKS))


def _search_coded(coded: DataFrame, index: Index, keep: list[str]) -> DataFrame:
    """The same of documents that are term numbers already."""
    shared = coded.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _lots(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], _found(shared.value, *_lists(part.column(0)))], [*keep, "leaks"])

    return coded.select("_ids", *[F.col(f"`{k}`") for k in keep]).mapInArrow(run, schema_with(coded, keep, leaks=LEAKS))


def _blocks(benchmark: DataFrame, item: str, text: str, answer: str | None, block: int) -> Iterator[list]:
    count = -(-benchmark.count() // block)
    chosen = benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`"), F.col(f"`{answer}`") if answer else F.lit(None))
    for i in range(count):
        yield chosen.where(F.pmod(F.xxhash64(F.col(f"`{item}`")), F.lit(count)) == i).collect()


def with_leaks(df: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
               item_text: str = "text", answer: str | None = None, block: int = BLOCK) -> DataFrame:
    """Every row with its kept columns and ``leaks``: the items found in it."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{text}`").alias("text"))
    out = df.withColumn("_leaks", F.array().cast(LEAKS))
    for rows in _blocks(benchmark, item, item_text, answer, block):
        index = build_index(docs, rows)
        if index is not None:
            columns = [*df.columns, "_leaks"]
            out = _search(out, index, columns, text).withColumn("_leaks", F.concat("_leaks", "leaks")).select(columns)
    return out.select(*keep, F.col("_leaks").alias("leaks"))


def leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
          item_text: str = "text", answer: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, item_id, word, cosine, share, answer_share): every pair of a document and an item that leaked into it."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = df.sparkSession.createDataFrame([], f"`{key}` {kind}, {LEAK}")
    for rows in _blocks(benchmark, item, item_text, answer, block):
        index, coded = _indexed(df, rows, [key], text)
        if index is not None:
            out = out.unionByName(_search_coded(coded, index, [key]).select(f"`{key}`", F.inline("leaks")))
    return out

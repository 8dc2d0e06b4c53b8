"""Personal data by bootstrapped contextual extraction.

1. Seeds. E-mail addresses, IP addresses, card numbers and phone numbers that fixed patterns and checks (parts to 255,
   Luhn, number of digits) prove. Matches are leftmost and do not overlap, kind by kind; those that fail a check are
   dropped and their text is not tried again. Seeds are always reported.
2. Candidates. Spans of the looser shape of an identifier that no seed covers: addresses with a written-out ``(at)`` or
   without a domain's dot, version 6 addresses, numbers of 7 to 19 digits without plus sign or valid check digit.
3. Patterns. The words around a seed or candidate make three lexical patterns of its kind: two words before it, one on
   either side, two after it (lower case, digits as 0).
4. Graph. Patterns and instances (the bare characters of a span) are the two sides of a graph with one edge a pair,
   however often it occurs. Seeds score 1. Round by round, a pattern's confidence is the sum of its instances'
   scores, against that sum, the instances of other kinds in the same words (these contradict it), a quarter of what is
   unknown, and one. Patterns below PRECISION or with less than SUPPORT in that sum stay out. An instance
   then scores the chance that not all of its patterns err. Instances found in one round strengthen patterns
   in the next, so contexts that no seed has are reached as well.
5. Instances that score ACCEPT or more are identifiers wherever they occur; their spans are added to the seeds.

Texts pass through Python once; what leaves are spans, digests and short patterns. Edges are made distinct by partial
aggregation before they are shuffled; patterns with fewer than SUPPORT instances can never count and leave the graph
first. Scores are joined by key, where Spark splits skewed partitions; nothing is collected or broadcast by us.

Defined cases: a null text is the empty text and has no spans; equal texts have equal spans; repeated rows come back as
often as they came; null keys are kept; an empty table gives no rows. Only key and text are read, so other
columns cannot clash. Work is linear in a text, also in one long run of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.common import schema_with, slices, small_batches, written

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
#: Sum of instance scores that a pattern needs, its least confidence, the least score of an identifier, and the rounds.
SUPPORT, PRECISION, ACCEPT, ROUNDS = 5, 0.8, 0.8, 4
#: Weight against a pattern of an instance of its own kind that nothing is known of.
UNKNOWN = 0.25
#: Code points on either side of a span that are searched for its words.
AROUND = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[({] ?[aA][tT] ?[\])}]")

_AT = re.compile(r"(?:@| ?[\[({] ?[aA][tT] ?[\])}] ?)"
                 r"([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?[dD][oO][tT] ?[\])}] ?)[A-Za-z0-9-]{1,63}){0,8})")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_NUMBER = re.compile(r"(?<![\w.@+-])\(?[0-9](?:[\x20()./-]{0,2}[0-9])++(?![\w@])")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
_BARE = re.compile(r"[^0-9a-z@:]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _addresses(text: str, tail: re.Pattern, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Spans of the tail and what may stand before it; runs back from the tail, so no run is read once for each start."""
    end = 0
    for m in tail.finditer(text):
        start, low = m.start(), max(end, m.start() - most if most else end)
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the fixed patterns prove, by kind and start."""
    out = [(EMAIL, a, b) for a, b in _addresses(text, _DOMAIN)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
    out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def candidates(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans of a looser shape that overlap nothing known and not each other."""
    found = [(EMAIL, a, b) for a, b in _addresses(text, _AT, 64)]
    found += [(IP, *m.span()) for m in _IP6.finditer(text)]
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 48 and 7 <= (n := len(_digits(m[0]))) <= 19:
            found.append((PHONE if n <= 12 or n <= 15 and m[0].startswith("00") else CARD, *m.span()))
    out, end, reach = [], 0, 0
    taken, at = sorted((a, b) for _, a, b in known), 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in found):
        while at < len(taken) and taken[at][0] < stop:
            reach = max(reach, taken[at][1])
            at += 1
        # All known spans that begin before `stop` end by `reach`; those that begin later do not touch this one.
        if start >= end and start >= reach:
            out.append((kind, start, stop))
            end = stop
    return out


def patterns(text: str, kind: int, start: int, end: int) -> list[str]:
    """The three lexical patterns around a span; an edge of the text counts as a word."""
    plain = lambda s: [_DIGIT.sub("0", w) for w in _WORD.findall(s.lower())]
    before, after = plain(text[max(0, start - AROUND):start])[-2:], plain(text[end:end + AROUND])[:2]
    before, after = ["^"] * (2 - len(before)) + before, after + ["$"] * (2 - len(after))
    name = KINDS[kind]
    return [f"{name}|{before[0]} {before[1]} _", f"{name}|{before[1]} _ {after[0]}", f"{name}|_ {after[0]} {after[1]}"]


def instance(text: str, kind: int, start: int, end: int) -> bytes:
    """Digest of kind and bare characters: the ways to write one number are one instance."""
    bare = text[start:end].lower()
    bare = _BARE.sub("", bare) if kind in (EMAIL, IP) else _digits(bare)
    return hashlib.blake2b(f"{kind}:{bare}".encode(), digest_size=16).digest()


_SPAN = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
_BASE = pa.list_(pa.struct(_SPAN))
_FOUND = pa.list_(pa.struct([*_SPAN, ("instance", pa.binary())]))
_EDGES = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.binary()), ("seed", pa.bool_())]))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, h, base, found, edges) row by row: seeds, candidates, and pairs of pattern and instance."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            base, found, edges = [], [], []
            for value in part.column(0).to_pylist():
                if not value or not _SIGN.search(value):
                    for column in (base, found, edges):
                        column.append([])
                    continue
                sure = seeds(value)
                maybe = candidates(value, sure)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in sure])
                found.append([dict(zip(("kind", "start", "end", "instance"), (*s, instance(value, *s)))) for s in maybe])
                edges.append([{"pattern": p, "instance": instance(value, *s), "seed": seed}
                              for group, seed in ((sure, True), (maybe, False)) for s in group for p in patterns(value, *s)])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(base, _BASE), pa.array(found, _FOUND), pa.array(edges, _EDGES)],
                [key, "h", "base", "found", "edges"])

    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), F.col(f"`{key}`").alias(key),
                       F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("h"))
    span = "kind:int,start:int,end:int"
    return rows.mapInArrow(run, schema_with(
        rows, [key, "h"], base=f"array<struct<{span}>>", found=f"array<struct<{span},instance:binary>>",
        edges="array<struct<pattern:string,instance:binary,seed:boolean>>"))


def graph(scanned: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """((pattern, instance, against) edges of patterns that can count, (instance, score) of the seeds).

    ``against`` is the number of instances of other kinds between the same words.
    """
    pairs = scanned.select(F.inline("edges")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    pairs = written(pairs, "pii-pairs")
    sizes = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "context", F.get(F.split("pattern", r"\|", 2), F.lit(1)))
    around = sizes.groupBy("context").agg(F.sum("n").alias("all"))
    enough = sizes.where(F.col("n") >= support).join(around, "context").select(
        "pattern", (F.col("all") - F.col("n")).alias("against"))
    edges = written(pairs.join(enough, "pattern").select("pattern", "instance", "against"), "pii-edges")
    known = written(pairs.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0)), "pii-seeds")
    return edges, known


def pattern_scores(edges: DataFrame, scores: DataFrame, support: int = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """(pattern, confidence, instances) of the patterns that count."""
    told = edges.join(scores, "instance", "left").groupBy("pattern").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("known"), F.count(F.lit(1)).alias("instances"), F.first("against").alias("against"))
    known = F.col("known")
    confidence = known / (known + UNKNOWN * (F.col("instances") - known) + F.col("against") + 1)
    return told.withColumn("confidence", confidence).where(
        (F.round("known", 9) >= support) & (F.col("confidence") >= precision)).select("pattern", "confidence", "instances")


def instance_scores(edges: DataFrame, confident: DataFrame, known: DataFrame) -> DataFrame:
    """(instance, score): 1 for seeds, else the chance that one of its confident patterns is right."""
    chance = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
    told = edges.join(confident.select("pattern", "confidence"), "pattern").groupBy("instance").agg(chance.alias("score"))
    return told.join(known.select("instance"), "instance", "left_anti").unionByName(known)


def bootstrap(scanned: DataFrame, support: int = SUPPORT, precision: float = PRECISION, rounds: int = ROUNDS) -> DataFrame:
    """(instance, score) after the rounds."""
    edges, known = graph(scanned, support)
    scores = known
    for _ in range(rounds):
        scores = written(instance_scores(edges, pattern_scores(edges, scores, support, precision), known), "pii-scores")
    return scores


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", support: int = SUPPORT, precision: float = PRECISION,
         accept: float = ACCEPT, rounds: int = ROUNDS) -> DataFrame:
    """(key, base, added) of every row: arrays of (kind: number in KINDS, start, end) by kind and start; code points, end exclusive."""
    scanned = written(scan(docs, key, text), "pii-scan")
    accepted = bootstrap(scanned, support, precision, rounds).where(F.col("score") >= accept).select("instance")
    held = scanned.select(F.col(key).alias("_key"), F.col("h").alias("_h"), F.inline("found"))
    added = held.join(accepted, "instance", "left_semi").groupBy("_key", "_h").agg(
        F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return scanned.select(F.col(key), "h", "base").join(
        added, F.col(key).eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")), "left").select(
        key, "base", F.coalesce("added", none).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of the result of ``find``."""
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{name}") for i, name in enumerate(KINDS)]
    return found.select(key, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))

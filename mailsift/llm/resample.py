"""Importance resampling towards a target distribution, by hashed n-grams and Gumbel noise.

Words are runs of digits, letters a to z (after A to Z were lowered) and everything beyond ASCII. Features are all
runs of 1 to ``most`` consecutive words; each falls into one of ``buckets`` by its crc32. A bucket's gain is
1000 times the logarithm of its share in the target over its share in the documents, both with one added,
rounded down. A document's weight is the sum of the gains of its features; its score adds Gumbel noise
drawn from a hash of its id. The highest scores of the documents with enough words are drawn.

Segments are counted once. Newlines separate words, so they cut a text into lines whose features within are
independent of their neighbours: distinct lines are found by aggregation, their features are counted once,
and the corpus counts take them times their occurrences, a document's weight as often as it holds them.
Runs that reach over a newline belong to no line; they are counted document by document and added.

Everything is column expressions. Lines that many documents share are combined before the shuffle and joined by
Spark's skew-split join; the gains, ``buckets`` numbers, are the only thing sent to all tasks. Ranks come
from ordered buckets of scores and their offsets, so no task sorts all scores.

Defined cases: a null text has no words; documents without words have weight 0; a null id draws its noise as the
text ``null`` and comes before other ids among equal scores; repeated rows come back as often as they came, each
with a rank of its own; an empty target has only the added ones; empty documents give no rows. Only key and
text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.llm.common import written
from mailsift.operators.ranking import with_value_bucket

BUCKETS, SEED, LEAST_WORDS = 10_000, 2024, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature) % F.lit(buckets)).cast("int")


def _runs(w: Column, size: int) -> Column:
    """All runs of ``size`` of the words, joined by a space."""
    starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<string>"))


def within(df: DataFrame, line: str, most: int, buckets: int) -> DataFrame:
    """``df`` with ``n_words`` of the line and ``found``, the bucket of every run of up to ``most`` of its words."""
    w = F.col("_words")
    grams = F.concat(w, *[_runs(w, m) for m in range(2, most + 1)]) if most > 1 else w
    return df.withColumn("_words", words(F.col(line))).withColumns({
        "n_words": F.size("_words"), "found": F.transform(grams, lambda g: _bucket(g, buckets))}).drop("_words")


def across(df: DataFrame, text: str, most: int, buckets: int) -> DataFrame:
    """``df`` with ``found``, the bucket of every run of 2 to ``most`` words that reaches over a newline."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), words)
    marked = F.flatten(F.transform(lines, lambda ws, i: F.transform(ws, lambda w: F.struct(w.alias("w"), i.alias("i")))))
    w = F.col("_words")

    def runs(m: int) -> Column:
        reaching = F.filter(F.sequence(F.lit(0), F.size(w) - m), lambda p: F.get(w, p)["i"] < F.get(w, p + (m - 1))["i"])
        text_of = lambda p: F.array_join(F.transform(F.slice(w, p + 1, m), lambda x: x["w"]), " ")
        return F.when(F.size(w) >= m, F.transform(reaching, lambda p: _bucket(text_of(p), buckets))).otherwise(
            F.array().cast("array<int>"))

    found = F.concat(*[runs(m) for m in range(2, most + 1)])
    return df.withColumn("_words", marked).withColumn("found", found).drop("_words")


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).drop("text")


def line_table(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """(line: digest, times, n_words, found) of the distinct lines."""
    distinct = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text")).groupBy("text").agg(
        F.count(F.lit(1)).alias("times"))
    return within(distinct, "text", most, buckets).select(_digest(F.col("text")).alias("line"), "times", "n_words", "found")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def bucket_counts(lines: DataFrame, crossing: DataFrame | None) -> DataFrame:
    """(bucket, n): features of the whole corpus by bucket."""
    seen = lines.select(F.explode("found").alias("bucket"), "times")
    if crossing is not None:
        seen = seen.unionByName(crossing.select(F.explode("found").alias("bucket"), F.lit(1).cast("bigint").alias("times")))
    return seen.groupBy("bucket").agg(F.sum("times").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets, from (bucket, n) of the documents and of the target."""
    all_of = lambda c: F.coalesce(c.agg(F.sum("n")).scalar(), F.lit(0))
    s, t = F.coalesce("s", F.lit(0)), F.coalesce("t", F.lit(0))
    share = ((t + 1).cast("double") * (all_of(source) + buckets).cast("double")) / (
        (s + 1).cast("double") * (all_of(target) + buckets).cast("double"))
    each = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return each.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").select(
        "bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain"))


def _weight(found: Column, table: str) -> Column:
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda a, b: a + F.get(F.col(table), b))


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
            most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = written(line_table(rows, most, buckets), "lines")
    aims = target.select(F.col(f"`{target_text}`").alias("text"))
    crossing = aims_crossing = None
    if most > 1:
        crossing = written(across(rows, "text", most, buckets).select("id", "h", "found"), "crossing")
        aims_crossing = across(aims, "text", most, buckets)
    gain = written(gains(bucket_counts(lines, crossing),
                         bucket_counts(line_table(aims, most, buckets), aims_crossing), buckets), "gains")
    by_bucket = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"])
    table = gain.agg(by_bucket.alias("g")).scalar()
    facts = lines.withColumn("_gains", table).select(
        "line", "n_words", F.size("found").alias("n"), _weight(F.col("found"), "_gains").alias("weight"))
    held = _lines(rows).select("id", "h", (F.col("at") == 0).cast("int").alias("copy"), _digest(F.col("line")).alias("line"))
    told = held.join(facts, "line").select("id", "h", "copy", "n_words", "n", "weight")
    if crossing is not None:
        told = told.unionByName(crossing.withColumn("_gains", table).select(
            "id", "h", F.lit(0).alias("copy"), F.lit(0).alias("n_words"), F.size("found").alias("n"),
            _weight(F.col("found"), "_gains").alias("weight")))
    # Rows that share id and text are summed together and shared out again.
    share = lambda c: F.expr(f"sum({c}) div sum(copy)").alias(c)
    sums = told.groupBy("id", "h").agg(share("n_words"), share("n"), share("weight")).withColumnsRenamed({"id": "_id", "h": "_h"})
    return rows.select("id", "h").join(sums, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select(
        F.col("id").alias(key), "n_words", F.col("n").alias("n_features"), "weight")


def noise(key: Column, seed: int) -> Column:
    """1000 times a Gumbel draw from the hash of seed and key, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int, key: str = "doc_id", text: str = "text",
             target_text: str = "text", most: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             least: int = LEAST_WORDS) -> DataFrame:
    """(key, n_features, weight, score, rank): ranks 1, 2, 3... of the drawn rows, null for the others.

    Of the N rows with at least ``least`` words, the floor(percent * N / 100) highest scores are drawn.
    """
    if not 0 <= percent <= 100 or most < 1:
        raise ValueError("a percentage, and runs of one word at least")
    found = weights(docs, target, key, text, target_text, most, buckets)
    scored = written(found.select(
        F.col(f"`{key}`").alias("id"), "n_words", F.col("n_features").cast("bigint").alias("n_features"), "weight",
        (F.col("weight") + noise(F.col(f"`{key}`"), seed)).alias("score")), "scores")
    fit = with_value_bucket(scored.where(F.col("n_words") >= least), "score")
    sizes = written(fit.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "score-buckets")
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    draw = F.coalesce(F.floor(sizes.agg(F.sum("_n")).scalar() * percent / 100), F.lit(0))
    inside = Window.partitionBy("_bucket").orderBy(F.desc("score"), "id")
    ranked = fit.join(F.broadcast(offsets), "_bucket").withColumn("rank", (F.col("_above") + F.row_number().over(inside)).cast("bigint"))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(scored.columns + ["rank"])
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint"))
    return out.unionByName(rest).select(F.col("id").alias(key), "n_features", "weight", "score", "rank")


__all__ = ["resample", "weights", "gains", "words", "noise"]

"""Secret scans over all versions of all files by a ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its content. The ledger, a table in the
shared folder, has one row for each pair of blob and rule version ever scanned, with the spans found
(none, if it is clean). A run scans only pairs that the ledger lacks, each blob once however many paths
hold it, appends them in one committed write, and joins the spans back to all paths. A new version of one
rule rescans all blobs for that rule alone. A run that dies leaves no rows, so its pairs are scanned again.

Matches are leftmost and do not overlap, rule by rule; those whose value is too short are dropped after
matching. Spans count code points, the end is exclusive. Everything is column expressions: the text
between matches and the matches give lengths, and a running sum over one blob's matches gives positions.

Defined cases: a null text is the empty text; a text without matches has an empty list; equal texts share
a blob; repeated rows come back as often as they came; null keys are kept. Only keys and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailsift.llm.common import written
from mailsift.operators.skew import join_facts
from mailsift.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``value`` is the group whose length must reach ``least``. A text that has none of the ``needs``
    (lower case) cannot match."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


RULES = [
    Rule("assign", 1, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
         r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
]

LEDGER = "blob string, kind string, version int, spans array<struct<start:int, end:int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows; an empty table where the ledger has not been started."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: code points before it since the last one, its length, and whether its value is long enough."""
    size = lambda c: F.char_length(c)
    pattern = F.lit(rule.pattern)
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value))
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), size).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), size).alias("size"),
        F.transform(values, lambda v: size(v) >= rule.least).alias("good"))
    lowered = F.lower(text)
    possible = text.rlike(rule.pattern)
    if rule.needs:
        any_need = F.contains(lowered, F.lit(rule.needs[0]))
        for need in rule.needs[1:]:
            any_need = any_need | F.contains(lowered, F.lit(need))
        possible = any_need & possible
    return F.when(possible, found)


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, spans) of the blobs (blob, text, todo: kinds to scan) that have any; repeats of a blob count once."""
    each = F.array(*[
        F.struct(F.lit(r.kind).alias("kind"),
                 F.when(F.array_contains("todo", r.kind), _matches(F.col("text"), r)).alias("found"))
        for r in rules])
    hits = blobs.select("blob", F.explode(each).alias("m")).where("m.found IS NOT NULL").select(
        "blob", "m.kind", F.posexplode("m.found").alias("at", "f")).where("f.size IS NOT NULL")
    once = hits.groupBy("blob", "kind", "at").agg(F.first("f").alias("f")).select("blob", "kind", "at", "f.*")
    upto = Window.partitionBy("blob", "kind").orderBy("at")
    ends = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    return ends.where("good").groupBy("blob", "kind").agg(F.sort_array(F.collect_list(
        F.struct((F.col("end") - F.col("size")).alias("start"), F.col("end")))).alias("spans"))


def scan(versions: DataFrame, ledger: str, rules: list[Rule] = RULES, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(key, blob, spans: array of kind, start, end ordered by start, then by rule) of every row.

    Scans what the ledger at that path lacks and adds it there.
    """
    spark = versions.sparkSession
    kinds = [r.kind for r in rules]
    if len(set(kinds)) != len(kinds):
        raise ValueError("one version of a rule at a time")
    source = versions.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    paths = written(source.select("key", blob_of(F.col("text")).alias("blob")), "paths")
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    seen = read_ledger(spark, ledger).where(F.col("version") == F.get(F.array(
        *[F.when(F.col("kind") == r.kind, F.lit(r.version)) for r in rules]), F.array_position(
        F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int") - 1))
    blobs = paths.groupBy("blob").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    known = seen.groupBy("blob").agg(F.collect_set("kind").alias("known"))
    todo = blobs.join(known, "blob", "left").select(
        "blob", "key", F.array_except(F.array(*[F.lit(k) for k in kinds]), F.coalesce("known", F.array())).alias("todo")
    ).where(F.size("todo") > 0)
    first = todo.select(F.col("blob").alias("_blob"), F.col("key").alias("_key"), "todo")
    unseen = source.withColumn("blob", blob_of(F.col("text"))).join(
        first, F.col("key").eqNullSafe(F.col("_key")) & (F.col("blob") == F.col("_blob"))).select("blob", "text", "todo")
    pairs = todo.select("blob", F.explode("todo").alias("kind"))
    rows = pairs.join(scan_blobs(unseen, rules), ["blob", "kind"], "left").select(
        "blob", "kind", F.element_at(current, F.col("kind")).alias("version"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    rows.write.mode("append").parquet(ledger)
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    now = read_ledger(spark, ledger).join(
        F.broadcast(spark.range(1).select(F.explode(F.map_entries(current)).alias("e")).select(
            F.col("e.key").alias("kind"), F.col("e.value").alias("version"))), ["kind", "version"], "left_semi")
    found = now.select("blob", "kind", order.alias("o"), F.explode("spans").alias("s")).groupBy("blob").agg(
        F.sort_array(F.collect_set(F.struct(F.col("s.start").alias("start"), "o", "kind", F.col("s.end").alias("end")))).alias("found"))
    facts = found.select("blob", F.transform("found", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))).alias("spans"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return join_facts(paths, facts, "blob").select(
        F.col("key").alias(key), "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redact(df: DataFrame, ledger: str, rules: list[Rule] = RULES, key: str = "doc_id", text: str = "text",
           mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret in its texts replaced by ``mark``; overlapping spans become one mark.

    Found by content, so the spans are joined by the blob and rows that share a key are told apart.
    """
    spans = scan(df, ledger, rules, key, text)
    facts = spans.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    rows = df.select(blob_of(F.col(f"`{text}`")).alias("blob"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    told = join_facts(rows, facts, "blob")
    whole = F.col("row").getField(text)
    done = F.aggregate(
        "spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s.end <= a["at"], a).otherwise(F.struct(
            F.when(s.start < a["at"], a["out"]).otherwise(F.concat(
                a["out"], F.substring(whole, a["at"] + 1, s.start - a["at"]), F.lit(mark))).alias("out"),
            s.end.alias("at"))),
        lambda a: F.concat(a["out"], F.substring(whole, a["at"] + 1, F.lit(2 ** 31 - 1))))
    return told.select(*[
        (F.when(F.col("spans").isNull(), whole).otherwise(done) if c == text else F.col("row").getField(c)).alias(c)
        for c in df.columns])


def new_ledger(spark: SparkSession) -> str:
    return scratch_path(spark, "ledger")

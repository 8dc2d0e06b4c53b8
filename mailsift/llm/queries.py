"""Queries of the corpus operators over the supplied tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.llm import (
    bpe, conversations, decontam, imatch, pii, quality, resample, secrets, sharding, simhash, suffix_dedup, toxicity, warc)
from mailsift.llm.common import documents, held_out, written
from mailsift.session import scratch_path
from mailsift.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


def _span_sql(kind: str, order: int) -> str:
    rule = {r.kind: r for r in secrets.RULES}[kind]
    p = "'" + rule.pattern.replace("'", "''") + "'"
    return (
        f"list_transform(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: {{'good': "
        f"length(regexp_extract_all(t, {p}, {rule.value})[i]) >= {rule.least}, 's': "
        f"list_sum(list_transform(regexp_split_to_array(t, {p})[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0), "
        f"'o': {order}, 'kind': '{kind}', 'n': length(regexp_extract_all(t, {p})[i])}})")


SECRETS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_filter(list_concat({', '.join(_span_sql(r.kind, i) for i, r in enumerate(secrets.RULES))}),
  lambda x: x.good) AS f FROM d),
j AS (SELECT doc_id, f, coalesce(array_to_string(list_transform(list_sort(list_transform(f, lambda x:
  {{'s': x.s, 'o': x.o, 'kind': x.kind, 'n': x.n}})), lambda x: x.kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ','), '') AS spans FROM f)
SELECT doc_id, {', '.join(f"len(list_filter(f, lambda x: x.kind = '{r.kind}')) AS n_{r.kind}" for r in secrets.RULES)},
  sha256(spans) AS base_sha256, spans FROM j"""


@query("op1_secrets", SECRETS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(documents(spark, folder), secrets.new_ledger(spark))
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, r.kind))).cast("long").alias(f"n_{r.kind}")
              for r in secrets.RULES]
    spans = secrets.joined(F.col("spans"))
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@query("op2_imatch")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return imatch.probe(docs, imatch.lexicon(docs))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


@query("op3_sharding")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's shard by its id, its shard after the last one is lost, and its shard by source."""
    docs = documents(spark, folder, "doc_id", "source")
    placed = sharding.place(docs, ["doc_id"], SHARDS)
    after = sharding.place(placed, ["doc_id"], SHARDS[:-1], out="shard_after_loss")
    return sharding.place_groups(after, "source", "doc_id", SHARDS, out="source_shard").select(
        "doc_id", "shard", "shard_after_loss", "source_shard")


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS g FROM pages),
q AS (SELECT *, strlen(h) AS n, CASE WHEN strlen(h) >= {warc.LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY h) END AS top FROM p)
SELECT page_id, n AS payload_bytes, g AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM q"""


@query("op4_warc", WARC_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs, kept_back = documents(spark, folder), held_out(5, 0)
    found = toxicity.scored(docs, table(spark, folder, "labels"), kept_back)
    return found.select("doc_id", kept_back.alias("held_out"), "score", "predicted")


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, folder))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs, kept_back = documents(spark, folder), held_out(3, 1)
    read = written(quality.read(docs, ["doc_id"]), "read")
    ranker = quality.fit_read(read, table(spark, folder, "labels"), kept_back)
    return quality.score_read(read, ranker, ["doc_id"]).select("doc_id", kept_back.alias("held_out"), "score", "predicted")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.encode(documents(spark, folder), VOCABULARY, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), words=3, k=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op10_decontamination")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a document and a benchmark item found in it."""
    return decontam.leaks(documents(spark, folder), table(spark, folder, "benchmark"))


def _crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes; needs ``crc(tab)`` of CRC_SQL in scope."""
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(range(0, CAST(length(hex(encode({text}))) / 2 AS BIGINT)), "
            f"lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), "
            f"lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""

_WORDS_SQL = ("unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))")
DRAWN_PERCENT = 10

RESAMPLE_SQL = f"""
WITH {CRC_SQL},
dw AS (SELECT doc_id, count(*) AS c, w FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents) GROUP BY doc_id, w),
bw AS (SELECT count(*) AS c, w FROM (SELECT {_WORDS_SQL} AS w FROM benchmark) GROUP BY w),
vocab AS (SELECT w, {_crc32_sql('w')} % {resample.BUCKETS} AS b
  FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)), crc),
src AS (SELECT b, sum(c) AS s FROM dw JOIN vocab USING (w) GROUP BY b),
aim AS (SELECT b, sum(c) AS t FROM bw JOIN vocab USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000.0::DOUBLE * ln(
    (CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(s) FROM src), 0) + {resample.BUCKETS} AS DOUBLE)) /
    (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(coalesce((SELECT sum(t) FROM aim), 0) + {resample.BUCKETS} AS DOUBLE)))) AS BIGINT) AS g
  FROM src FULL JOIN aim USING (b)),
weighed AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * g) AS BIGINT) AS w
  FROM dw JOIN vocab USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln(
    (CAST('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed q ON d.doc_id = q.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= {resample.LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= {DRAWN_PERCENT} * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)"""


@query("op11_conversations")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


@query("op12_pii")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest_columns(pii.find(documents(spark, folder)))


@query("op13_resampling", RESAMPLE_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(documents(spark, folder), table(spark, folder, "benchmark"), percent=DRAWN_PERCENT)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

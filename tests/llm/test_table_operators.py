"""Secrets, sharding, WARC, the two classifiers and the pipeline against plain versions."""

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Window, functions as F

import corpus_pipeline
from mailsift.llm import bpe, common, quality, queries, secrets, sharding, simhash, toxicity, warc
from mailsift.llm.common import held_out
from mailsift.session import scratch_path

CLASH = ", blob string, kind string, spans string, n bigint, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "b", "k", "s", 1, "q") for i, t in rows], "doc_id bigint, text string" + CLASH).repartition(parts)


# --- secrets ------------------------------------------------------------------------------

RULES = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
TEXTS = [
    "", None, "nothing here", "password: hunter2hunter2 and token=abc", "é PassWord = 'abcdef' ünd api_key:\"x.y/z+1=\"",
    "token=token: abcdefg", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 30, "0" * 23, "f" * 24 + "g" + "1" * 40,
    "secret=" + "a" * 30 + " tail", "apikey =abc123 apikey= abc12 API_KEY:Zz-9_=", "😀 token: ABCDEF",
    "passwd\t= abcdefgh", "secret  :   'abcdefg' " * 50, "AKIA" + "D" * 20 + "password=" + "0" * 30,
]


def plain_spans(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(spark):
    rows = list(enumerate(TEXTS)) + [(40, TEXTS[3]), (40, TEXTS[3]), (None, TEXTS[4])]
    got = secrets.scan(frame(spark, rows), secrets.new_ledger(spark)).collect()
    assert sorted((repr(r.doc_id), [tuple(s) for s in r.spans]) for r in got) == sorted((repr(k), plain_spans(t)) for k, t in rows)


def test_ledger_is_incremental(spark):
    ledger = secrets.new_ledger(spark)
    first, more = list(enumerate(TEXTS[:8])), list(enumerate(TEXTS))
    secrets.scan(frame(spark, first), ledger).count()
    before = secrets.read_ledger(spark, ledger).count()
    assert before == 3 * len({t or "" for t in TEXTS[:8]})
    got = secrets.scan(frame(spark, more), ledger).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in got) == sorted((k, plain_spans(t)) for k, t in more)
    after = secrets.read_ledger(spark, ledger)
    assert after.count() == after.select("blob", "kind", "version").distinct().count() == 3 * len({t or "" for t in TEXTS})
    changed = [*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{30,}", 0, 30)]
    got = secrets.scan(frame(spark, more), ledger, changed).collect()
    assert sum(s.kind == "hex" for r in got for s in r.spans) < sum(k == "hex" for t in TEXTS for k, *_ in plain_spans(t))
    assert secrets.read_ledger(spark, ledger).where("version = 2").count() == len({t or "" for t in TEXTS})


def plain_redact(text):
    if not plain_spans(text):
        return text
    out, at = "", 0
    for _, a, b in plain_spans(text):
        if b <= at:
            continue
        if a >= at:
            out += text[at:a] + "[secret]"
        at = b
    return out + text[at:]


def test_redact(spark):
    rows = list(enumerate(TEXTS)) + [(3, "other text"), (None, TEXTS[5])]
    done = secrets.redact(frame(spark, rows), secrets.new_ledger(spark))
    assert done.columns == frame(spark, []).columns
    assert sorted((repr(r.doc_id), repr(r.text)) for r in done.collect()) == sorted((repr(k), repr(plain_redact(t))) for k, t in rows)
    assert secrets.scan(frame(spark, []), secrets.new_ledger(spark)).count() == 0


# --- sharding -----------------------------------------------------------------------------

def plain_table(shards, size):
    order = []
    for s in shards:
        a, b = (int.from_bytes(hashlib.sha256(f"{u}|{s}".encode()).digest()[:8], "big") for u in ("offset", "skip"))
        order.append([(a + i * (b % (size - 1) + 1)) % size for i in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        i = turn % len(shards)
        owner[next(s for s in order[i] if s not in owner)] = i
        turn += 1
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 31), (7, 251)])
def test_lookup_table(n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(shards, size)
    assert table == plain_table(shards, size)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 250)


def test_placement(spark):
    shards = queries.SHARDS
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("one").alias("source"), "id")
    placed = sharding.place(df, ["doc_id"], shards)
    rows = placed.where("doc_id IS NOT NULL").groupBy("shard").count().collect()
    assert len(rows) == 64 and max(r["count"] for r in rows) < 2 * min(r["count"] for r in rows)
    assert placed.where("doc_id IS NULL").select("shard").distinct().count() == 1
    both = sharding.place(placed, ["doc_id"], shards[:-1], out="after").where("doc_id IS NOT NULL")
    moved = both.where("shard <> after AND shard <> 'shard-063'").count()
    assert moved < 0.05 * both.count()
    assert sharding.place_groups(df, "source", "id", shards).select("shard").distinct().count() == 64
    assert sharding.place(df.limit(0), ["doc_id"], shards).count() == 0
    with pytest.raises(ValueError):
        sharding.place(placed, ["doc_id"], shards)


# --- WARC ---------------------------------------------------------------------------------

def pages(spark, parts):
    rows = [(i, f"http://h/{i}", "x" * (i % 7) * 300 + "é" * (i % 3)) for i in range(200)]
    rows += [(900, None, None), (901, "a\r\nb: c", ""), (None, "http://n", "y" * 2000), (902, "u", "y" * 2000), (5, "again", "z")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string").repartition(parts)


def test_warc(spark):
    rows, df = pages(spark, 5)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write(df, folder, shard_bytes=30_000, roll_bytes=2_000)
    assert manifest.select("shard").distinct().count() > 3
    top = {}
    for key, _, html in rows:
        if html and len(html.encode()) >= 1000 and key is not None:
            top[html] = max(top.get(html, -1), key)
    expected = []
    for key, url, html in rows:
        raw = (html or "").encode()
        refers = top.get(html) if html in top and top[html] != key else None
        expected.append((repr(key), None if url is None else " ".join(url.split()), len(raw), hashlib.sha1(raw).hexdigest(),
                         "revisit" if refers is not None else "response", refers, None if refers is not None else raw))
    got = [(repr(r.page_id), r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
            None if r.payload is None else bytes(r.payload)) for r in warc.read(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_warc_is_deterministic(spark):
    files = []
    for parts in (1, 7):
        folder = scratch_path(spark, "warc-same")
        rows = warc.write(pages(spark, parts)[1], folder, shard_bytes=30_000, roll_bytes=2_000)
        files.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in rows.collect()))
        spread = warc.read(spark, folder, task_bytes=10_000)
        assert spread.rdd.getNumPartitions() > 1 and spread.exceptAll(warc.read(spark, folder)).count() == 0
        names = set(os.listdir(folder.removeprefix("file:")))
        assert names >= {f[0] for f in files[-1]} | {"manifest"}
    assert files[0] == files[1]
    folder = scratch_path(spark, "warc-none")
    assert warc.write(pages(spark, 1)[1].limit(0), folder).count() == 0 and warc.read(spark, folder).count() == 0


def test_warc_notices_damage():
    member = warc.record(1, "u", b"payload", "c", None, warc.DATE)
    import zlib
    plain = zlib.decompress(member, 31)
    assert warc.parse(plain)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(plain.replace(b"payload\r\n\r\n", b"paylaad\r\n\r\n"))


# --- classifiers --------------------------------------------------------------------------

@pytest.mark.parametrize("module,label,back", [(toxicity, "toxic", (5, 0)), (quality, "quality", (3, 1))])
def test_classifier(spark, module, label, back):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = module.fit(docs, labels, held_out(*back))
    rows = module.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(held_out(*back)).toPandas()
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()
    truth = rows[label]
    assert rows.predicted[truth == 1].mean() > 0.85 and rows.predicted[truth == 0].mean() < 0.1
    odd = frame(spark, [(1, None), (2, ""), (3, "\n"), (3, "\n"), (None, "x" * 100_000)])
    got = module.score(odd, model, ["doc_id"]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert module.score(odd.limit(0), model, ["doc_id"]).count() == 0
    few = labels.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("doc_id"))).where("_n <= 4")
    assert 0 <= module.score(odd, module.fit(docs, few, F.lit(False)), ["doc_id"]).agg(F.min("score")).head()[0] <= 1
    none = module.fit(docs, labels.limit(0), held_out(*back))
    assert {r.score for r in module.score(odd, none, ["doc_id"]).collect()} == {0.0 if module is toxicity else 0.5}


def test_labels_are_learned_from_the_right_rows(spark):
    import zlib
    ids = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "doc_id bigint")
    for r in ids.select("doc_id", held_out(5, 0).alias("out")).collect():
        assert r.out == (zlib.crc32(("null" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)


def test_disguised_words_are_found_at_once_in_long_runs():
    import random
    import re
    plain = re.compile(r"[^\W\d_]+(?:[0-9@$!|*.\-_+]+[^\W\d_]+)+|[@$0-9]+[^\W\d_]{2,}")
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("aBcé_ß1 2@$!|*.-+9 ñ\n#x٣") for _ in range(rng.randint(0, 25)))
        assert toxicity._DISGUISED.findall(text) == plain.findall(text)
        assert toxicity.disguised(text) == [w.translate(toxicity._PLAIN) for w in plain.findall(text.lower())]
        assert toxicity.plain(text) == f" {toxicity._WORDS.sub(' ', text.lower()).strip()} "
    for run in ("x" * 300_000 + " 1a", "1" * 300_000 + " 1a", "a" * 300_000 + "." * 300_000):  # quadratic before
        assert toxicity.disguised(run) == []


def test_one_reading_serves_fit_and_scores(spark):
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "vile1y", "n4sty"]
    rows = [(i, " ".join(words[(i * k) % 5 + (2 if i % 3 == 0 else 0)] for k in range(1, 9)) + "!" * (i % 3 == 0)) for i in range(300)]
    docs = frame(spark, rows + [(300, None), (301, ""), (None, "lorem"), (5, "lorem ipsum")])
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(0, 300, 2)] + [(4, None, None)],
                                   "doc_id bigint, toxic int, quality int")
    found = lambda df: sorted((repr(r.doc_id), round(r.score, 9), r.predicted) for r in df.collect())
    twice = toxicity.score(docs, toxicity.fit(docs, labels, held_out(5, 0)), ["doc_id"])
    once = found(toxicity.scored(docs, labels, held_out(5, 0)))
    assert len(once) == 304 and once == found(twice)
    read = quality.read(docs, ["doc_id"])
    assert read.columns == ["doc_id", "x"]
    once = found(quality.score_read(read, quality.fit_read(read, labels, held_out(3, 1)), ["doc_id"]))
    assert len(once) == 304 and once == found(quality.score(docs, quality.fit(docs, labels, held_out(3, 1)), ["doc_id"]))


# --- pipeline -----------------------------------------------------------------------------

def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept, now = [set(texts)], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        assert sorted(now.columns) == sorted(docs.columns)
        kept.append({r.doc_id for r in now.collect()})
        assert kept[-1] <= kept[-2], name
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").collect()}
    assert len(kept[0] & toxic - kept[1]) <= 0.05 * len(toxic)
    left = sorted(kept[1])
    points = [simhash.fingerprint(texts[i].encode()) for i in left]
    root = {}
    for a, i in enumerate(left):
        root[i] = i
        for b in range(a):
            if bin(points[a] ^ points[b]).count("1") <= 3:
                x, y = i, left[b]
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert kept[2] == {i for i in left if root[i] == i}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {i for i in kept[2] if any(t in texts[i] for t in items)} <= kept[2] - kept[3]
    assert {r.doc_id: r.text for r in now.collect()} == {i: plain_redact(texts[i]) for i in kept[3]}
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY))
    last = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()}
    assert last == {i: np.array(tokenizer.encode_ordinary(plain_redact(texts[i])), "<u4").tobytes() for i in kept[3]}


def test_pipeline_takes_odd_rows(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(5).unionByName(docs.limit(5)).withColumn("score", F.lit(1.0)).withColumn("predicted", F.lit("x")).withColumn(
        "_row", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (777, None, "en", None, 0), (778, "", None, "s", None)], docs.schema),
        allowMissingColumns=True)
    for source in (odd, odd.limit(0)):
        now = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == now.count()


HELPERS = ["_hot", "_spans", "_group", "_slot", "_identity", "_row", "_whole", "_blob", "_owner", "_shard", "_own", "_key", "spans",
           "row", "blob", "component", "fp", "_text", "leaks", "_leaks", "predicted"]


@pytest.mark.parametrize("apply", [
    lambda df: secrets.redact(df, secrets.new_ledger(df.sparkSession)),
    lambda df: sharding.place_groups(df, "source", "doc_id", ["a", "b"], 101, out="placed").drop("placed"),
    lambda df: simhash.keep_one(df), lambda df: corpus_pipeline.drop_near_duplicates(df.sparkSession, df, ""),
], ids=["redact", "place_groups", "keep_one", "stage"])
def test_helper_names_as_extra_columns(spark, apply):
    """Columns named like the operators' own helpers pass through unchanged."""
    columns = ["doc_id", "text", "source", *HELPERS]
    rows = [(i, f"plain text number {i} about {i * 7} things", "s", *[f"{h}{i}" for h in HELPERS]) for i in range(20)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'bigint' if c == 'doc_id' else 'string'}" for c in columns))
    got = apply(df)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == rows


def test_fits_use_every_labelled_row(spark):
    rows = 30_000
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    labels = spark.range(rows).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    known = common.labelled_rows(docs, labels.unionByName(labels.where("doc_id < 9")), "quality", F.col("doc_id") % 3 == 1)
    assert known.agg(F.count("*"), F.sum("label")).head()[:] == (20_000, 10_000.0)

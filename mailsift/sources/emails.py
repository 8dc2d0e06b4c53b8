"""Email tables derived from the supplied tables (no raw email table is shipped with them).

``documents`` gives the text, the first event of a document's slot of ``events`` gives time and
user, ``labels`` gives the class. Both are one row a document after aggregation, so the optimiser drops
a join whose columns are not used, and a query that needs the body alone moves no text.
The same text runs in Spark and in the SQL twin, where it becomes leading CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.session import use_utc
from mailsift.sources.readers import table

EMAILS = """
SELECT
  d.doc_id AS email_id,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL
       ELSE 'user' || CAST(e.user_id AS STRING) || '@'
            || CASE WHEN d.doc_id % 4 = 0 THEN upper(d.source) ELSE d.source END || '.example.com' END AS sender,
  CASE WHEN d.doc_id % 6 = 0 THEN NULL
       ELSE 'team' || CAST(d.doc_id % 12 AS STRING) || '@corp.example.org' END AS receiver,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL ELSE e.ts END AS date,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL
       WHEN d.doc_id % 7 = 0 THEN 'Re: ' || split_part(d.text, chr(10), 1)
       WHEN d.doc_id % 5 = 0 THEN upper(replace(split_part(d.text, chr(10), 1), 'ß', 'ss'))
       WHEN d.doc_id % 9 = 0 THEN 'URGENT: verify now! ' || split_part(d.text, chr(10), 1)
       ELSE split_part(d.text, chr(10), 1) END AS subject,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL
       ELSE d.text
         || CASE WHEN d.doc_id % 3 = 0 THEN ' Visit http://' || d.source || '.example.net/' || CAST(d.doc_id AS STRING) ELSE '' END
         || CASE WHEN d.doc_id % 10 = 1 THEN ' http://bit.ly/' || CAST(d.doc_id AS STRING) ELSE '' END
         || CASE WHEN d.doc_id % 14 = 2 THEN ' https://10.0.0.7/login?' ELSE '' END
         || CASE WHEN d.doc_id % 11 = 0 THEN ' <b>bank account</b> password!' ELSE '' END END AS body,
  CASE WHEN d.doc_id % 29 = 0 THEN 'http://goo.gl/x; http://t.co/y' ELSE NULL END AS links,
  CAST(d.doc_id % 2 AS INT) AS has_attachment,
  CAST(CASE WHEN d.doc_id % 2 = 1 THEN d.doc_id % 4 ELSE 0 END AS INT) AS num_attachments,
  CAST(coalesce(1 - l.quality, CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END) AS INT) AS label
FROM documents d
LEFT JOIN slot_events e ON e.slot = d.doc_id
LEFT JOIN label_rows l ON l.doc_id = d.doc_id
"""


LABEL_ROWS = "SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id"


#: Session setting with the same meaning as ``partitions`` of :func:`emails`.
PARTITIONS = "mailsift.emails.partitions"


#: Below so many documents dealing them costs more than it saves.
FEW = 2_000


def tasks_for(spark: SparkSession, folder: str) -> int | None:
    """``partitions`` for :func:`emails` where much is derived from each text: as many as cores if a task
    would read more than twice its share of the documents, as of a file that is one row group; else none."""
    rows = table(spark, folder, "documents").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    largest, total = rows.agg(F.max("n"), F.sum("n")).head()
    cores = spark.sparkContext.defaultParallelism
    return cores if total and total >= FEW and largest * cores > 2 * total else None


def emails(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    """``partitions`` deals the documents by id before anything is derived from them.

    It is for files of few, large row groups, which Spark cannot split; the texts are shuffled once for it.
    Without it, and without the session's setting, they are read as stored.
    """
    use_utc(spark)
    docs, events, labels = (table(spark, folder, n) for n in ("documents", "events", "labels"))
    partitions = partitions or int(spark.conf.get(PARTITIONS, "0"))
    if partitions:
        docs = docs.repartition(partitions, "doc_id")
    sql = f"WITH slot_events AS ({slot_events_sql('DIV', 'min_by', 'DECIMAL(38, 0)')}), label_rows AS ({LABEL_ROWS}) {EMAILS}"
    for name in ("documents", "events", "labels"):
        sql = sql.replace(f"FROM {name}", "FROM {" + name + "}").replace(f"JOIN {name}", "JOIN {" + name + "}")
    return spark.sql(sql, documents=docs, events=events, labels=labels)


def slot_events_sql(div: str, arg_min: str, wide: str) -> str:
    """Events fall into as many equal id slots as there are documents; a slot keeps its earliest one."""
    return (
        f"SELECT CAST(CAST(event_id AS {wide}) * (SELECT count(*) FROM documents) {div} (SELECT count(*) FROM events) AS BIGINT) AS slot, "
        f"{arg_min}(ts, event_id) AS ts, {arg_min}(user_id, event_id) AS user_id FROM events GROUP BY 1"
    )


def emails_cte() -> str:
    """The same table as leading CTEs of an SQL twin."""
    return f"slot_events AS ({slot_events_sql('//', 'arg_min', 'HUGEINT')}), label_rows AS ({LABEL_ROWS}), emails AS ({EMAILS})"

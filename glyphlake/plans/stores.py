"""Registered queries of archives as a data source, streamed replies as files, checked writes and the snapshot log, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import payload
from ..session import shared, table
from ..sources import archives, snapshots
from .catalog import query


def _kept(rows, name: str, **options):
    """Rows(name, content) written as archives of the shared folder and read back."""
    spark = rows.sparkSession
    archives.register(spark)
    path = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.format("members").mode("overwrite").save(path)
    return spark.read.format("members").options(**options).load(path)


@query("SELECT concat('page/', page_id, '.HTML') AS name, strlen(coalesce(html, ''))::BIGINT AS size, sha256(coalesce(html, '')) AS digest FROM pages")
def archive_members(spark, d):
    """Every page as a member of an archive beside a resource fork and a text file of its address; those of HTML are read
    back."""
    pages = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("page"), *[F.encode(F.coalesce(c, F.lit("")), "UTF-8").alias(c) for c in ("url", "html")])
    member = lambda before, after, c: F.struct(F.concat(F.lit(f"page/{before}"), "page", F.lit(after)).alias("name"), F.col(c).alias("content"))
    rows = pages.select(F.inline(F.array(member("", ".HTML", "html"), member("._", ".html", "url"), member("", ".txt", "url"))))
    return _kept(rows, "members", suffixes=".html,.htm").select("name", "size", F.sha2("content", 256).alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn, concat('data: {"model":"m","object":"chat.completion.chunk","choices":[{"index":0,"delta":{"role":"assistant","content":', to_json(text), '},"finish_reason":null}]}', chr(10), chr(10), 'data: {"model":"m","object":"chat.completion.chunk","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10)) AS body FROM t)
SELECT concat(conv_id, '/', turn, '.sse') AS name, strlen(body)::BIGINT AS size, body FROM b""")
def stored_replies(spark, d):
    """The assistant's answers as whole event streams, each a member of an archive, read back."""
    talk = table(spark, d, "conversations").where("role = 'assistant'")
    body = payload.event_stream(F.col("text"), "m")
    rows = talk.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".sse")).alias("name"), F.encode(body, "UTF-8").alias("content"))
    return _kept(rows, "replies").select("name", "size", F.decode("content", "UTF-8").alias("body"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS refused FROM orders GROUP BY o_orderpriority")
def checked_orders(spark, d):
    """Orders put in place under rules; a second write, in which one order in a hundred breaks a rule, is refused and changes
    nothing."""
    path = f"{shared(spark)}/checked-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rules = {"key": F.col("o_orderkey").isNotNull(), "price": F.col("o_totalprice") >= 0}
    there = snapshots.checked_write(orders, path, rules)
    refused = False
    try:
        snapshots.checked_write(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, -1.0).otherwise(F.col("o_totalprice"))), path, rules)
    except snapshots.Refused:
        refused = True
    return there.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("refused", F.lit(refused))


@query("""WITH a AS (SELECT unnest([2, 3, 4, 5, 6]) AS asked, unnest([2, 2, 4, 5, 5]) AS version) SELECT asked, version, event_type, count(*) AS n, max(event_id) AS latest FROM a JOIN events ON event_id % 5 < version GROUP BY ALL""")
def snapshots_as_of(spark, d):
    """A table that grows in five versions; the newest two and every second stay, and each version asked for gets the newest
    that isn't newer."""
    log = f"{shared(spark)}/log-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "event_type")
    for version in range(1, 6):
        snapshots.commit(events.where(F.col("event_id") % 5 < version).withColumn("version", F.lit(version)), log, version, keep=2, every=2)
    out = None
    for asked in range(2, 7):
        rows = snapshots.as_of(spark, log, asked).groupBy("version", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("latest")).withColumn("asked", F.lit(asked))
        out = rows if out is None else out.unionByName(rows)
    return out.select("asked", "version", "event_type", "n", "latest")

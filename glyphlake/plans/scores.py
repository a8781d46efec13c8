"""Registered queries of scores of reads, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import scoring
from ..session import table
from .catalog import query


@query("""WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pos FROM conversations)
SELECT a.conv_id, a.pos::INT AS pos, a.text AS read, u.text AS truth FROM n a JOIN n u ON a.conv_id = u.conv_id AND a.pos = u.pos WHERE a.role = 'assistant' AND u.role = 'user'""")
def placed_pairs(spark, d):
    turns = table(spark, d, "conversations")
    return scoring.zipped(turns.where("role = 'assistant'"), turns.where("role = 'user'"), ["conv_id"], "turn", "text")


@query("""WITH p AS (SELECT role, coalesce(text, '') AS truth, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS read FROM conversations),
h AS (SELECT role, len(list_filter(range(1, least(length(read), length(truth)) + 1), lambda i: read[i] = truth[i])) AS h, length(truth) AS n, (read = truth)::INT AS s FROM p)
SELECT role, count(*) AS lines, sum(n)::BIGINT AS letters, sum(h)::BIGINT AS hits, round(sum(h) / greatest(sum(n), 1), 9) AS letter_rate, round(avg(s), 9) AS line_rate FROM h GROUP BY role""")
def letter_rates(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    told = scoring.hit_rates(table(spark, d, "conversations").select("role", F.col("text").alias("truth"), before.alias("read")), ["role"])
    return told.withColumns({c: F.round(c, 9) for c in ("letter_rate", "line_rate")})


@query("""WITH l AS (SELECT o_orderpriority, o_orderkey, o_orderstatus = 'P' AS gauge, 2 * l_quantity AS score, CASE WHEN l_tax = 0 THEN -1 ELSE l_discount * 10 END AS trust FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT o_orderpriority, o_orderkey, gauge, avg(score) AS m, avg(CASE WHEN trust >= 0 AND trust < 0.8 THEN 0 ELSE score END) AS g, count(*) FILTER (WHERE trust >= 0 AND trust < 0.8) AS u FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY gauge, round(m, 6), o_orderkey) AS k FROM p)
SELECT o_orderpriority, count(*) FILTER (WHERE NOT gauge) AS photos, round(avg(m) FILTER (WHERE NOT gauge), 6) AS mean, round(min(m) FILTER (WHERE NOT gauge), 6) AS low, count(*) FILTER (WHERE NOT gauge AND m >= 80) AS reached,
  max(o_orderkey) FILTER (WHERE k = 1 AND NOT gauge) AS worst, coalesce(sum(u) FILTER (WHERE NOT gauge), 0)::BIGINT AS unsure, round(avg(g) FILTER (WHERE NOT gauge), 6) AS gated, count(*) FILTER (WHERE gauge) AS gauge_photos, round(avg(m) FILTER (WHERE gauge), 6) AS gauge_mean
FROM r GROUP BY o_orderpriority""")
def photo_cards(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (2 * F.col("l_quantity")).alias("score"), F.when(F.col("l_tax") == 0, -1.0).otherwise(F.col("l_discount") * 10).alias("trust"))
    photos = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("gauge"))
    told = scoring.photo_card(lines.join(photos, "o_orderkey"), ["o_orderpriority"], "o_orderkey", "score", "trust", "gauge", 80.0)
    return told.withColumns({c: F.round(c, 6) for c in ("mean", "low", "gated", "gauge_mean")})


@query("""WITH k AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS c FROM lineitem QUALIFY c <= 3)
SELECT l_orderkey, l_partkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, c) - 1)::INT AS place FROM k""")
def first_boxes(spark, d):
    boxes = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("cut"))
    return scoring.first_lines(boxes, ["l_orderkey"], "cut", "l_quantity", 3).select("l_orderkey", "l_partkey", "l_linenumber", "place")

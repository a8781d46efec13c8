"""Registered queries of bitmap twins, fonts' coverage, reading within a roster and numbered batches, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import glyphs, numbering, twins, walking
from ..session import table
from .catalog import query

_IOU = 0.5


@query(f"""WITH f AS (SELECT vec_id, label, list_transform(embedding, lambda x: x > 0) AS f FROM embeddings), t AS (SELECT f, min(vec_id) AS vec_id FROM f WHERE label = 0 GROUP BY f),
p AS (SELECT i.vec_id AS id, t.vec_id AS twin, len(list_filter(list_zip(i.f, t.f), lambda z: z[1] AND z[2])) AS shared, len(list_filter(list_zip(i.f, t.f), lambda z: z[1] OR z[2])) AS united FROM f i JOIN t ON i.label <> 0)
SELECT id, twin, shared::INT AS shared, united::INT AS united, round(shared / united, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared / united DESC, twin) AS k FROM p WHERE united > 0 AND shared / united >= {_IOU}) WHERE k = 1""")
def bitmap_twins(spark, d):
    """Vectors as pictures, a pixel a component: those of label 0 are the test pictures."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", twins.packed(F.transform("embedding", lambda x: x > 0)).alias("bits"))
    found = twins.twins(rows.where("label <> 0"), rows.where("label = 0").withColumn("place", F.col("id")), _IOU)
    return found.withColumn("iou", F.round("iou", 9))


@query(r"""WITH c AS (SELECT concat(lang, '/', source) AS font, doc_id, unnest(list_distinct(string_split(text, ''))) AS glyph FROM documents), g AS (SELECT font, glyph FROM c WHERE glyph <> '' GROUP BY font, glyph HAVING count(*) >= 3),
e AS (SELECT DISTINCT concat(lang, '/', source) AS font FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL), l AS (SELECT conv_id, turn, list_filter(list_distinct(string_split(text, '')), lambda x: x <> '' AND NOT regexp_matches(x, '^\s$')) AS t FROM conversations),
h AS (SELECT conv_id, turn, len(t) AS n, unnest(t) AS glyph FROM l), m AS (SELECT conv_id, turn, font FROM h JOIN g USING (glyph) GROUP BY conv_id, turn, font, n HAVING count(*) = n), k AS (SELECT conv_id, turn, count(*) AS fonts FROM m GROUP BY ALL)
SELECT conv_id, turn, len(t)::INT AS letters, CASE WHEN len(t) = 0 THEN (SELECT count(*) FROM e) ELSE coalesce(fonts, 0) END::BIGINT AS fonts, CASE WHEN len(t) = 0 THEN (SELECT count(*) FROM e) ELSE coalesce(fonts, 0) END > 0 AS drawable FROM l LEFT JOIN k USING (conv_id, turn)""")
def drawable_by_fonts(spark, d):
    """A language of a source is a font that draws the letters of three of its documents or more; turns are the lines."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.concat_ws("/", "lang", "source").alias("font"), F.array_distinct(T.chars(F.col("text"))).alias("c"))
    seen = docs.select("font", F.explode("c").alias("glyph")).groupBy("font", "glyph").agg(F.count("*").alias("n")).where("n >= 3").select("font", "glyph")
    covers = seen.unionByName(docs.select("font", F.lit(None).cast("string").alias("glyph")).distinct())
    return glyphs.drawing(table(spark, d, "conversations"), covers, ["conv_id", "turn"])


_WALK = """o AS (SELECT DISTINCT string_split(p_name, ' ') AS t FROM part), i AS (SELECT t, unnest(range(0, len(t) + 1)) AS i FROM o),
e AS (SELECT DISTINCT array_to_string(t[1:i], ' ') AS node, coalesce(t[i + 1], '</s>') AS token, CASE WHEN i < len(t) THEN array_to_string(t[1:i + 1], ' ') END AS child FROM i)"""


@query(f"""WITH RECURSIVE {_WALK}, w AS (SELECT l_suppkey AS cell, list_append(string_split(p_name, ' '), '</s>') AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT cell, step, token, count(*) AS score FROM (SELECT cell, unnest(t) AS token, unnest(range(len(t))) AS step FROM w) GROUP BY ALL), z AS (SELECT max(len(t)) AS z FROM o),
f AS (SELECT DISTINCT cell, '' AS node, '' AS path, 0::BIGINT AS total, false AS done, 0::BIGINT AS step FROM s UNION ALL
  SELECT cell, node, path, total, done, step FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, path) AS k FROM (
    SELECT f.cell, coalesce(e.child, '') AS node, coalesce(e.child, f.path) AS path, (f.total + s.score)::BIGINT AS total, e.child IS NULL AS done, f.step + 1 AS step FROM f JOIN s ON f.cell = s.cell AND f.step = s.step JOIN e ON e.node = f.node AND e.token = s.token WHERE NOT f.done
    UNION ALL SELECT cell, node, path, total, done, step + 1 FROM f WHERE done AND step <= (SELECT z FROM z))) WHERE k <= 4)
SELECT cell, path AS text, total, len(string_split(path, ' '))::INT AS steps FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, path) AS k FROM f WHERE done AND step = (SELECT z + 1 FROM z)) WHERE k = 1""")
def roster_walk(spark, d):
    """What a supplier sells most, read within the roster of parts' names: each sale votes for its name's words, place by place."""
    names = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tokens"))
    sold = table(spark, d, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"))
    votes = sold.select(F.col("l_suppkey").alias("cell"), F.posexplode(F.array_append("tokens", F.lit(walking.END))).alias("step", "token")).groupBy("cell", "step", "token").agg(F.count("*").alias("score"))
    return walking.walk(votes, names.select("tokens").distinct())


@query(f"""WITH {_WALK}, p AS (SELECT o_orderkey, string_split(concat(p_name, CASE o_orderkey % 4 WHEN 0 THEN ' nowhere' ELSE '' END), ' ') AS t, o_orderkey FROM orders JOIN part ON p_partkey = o_custkey % 2000 + 1),
q AS (SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey % 4 IN (0, 1) THEN t ELSE t[1:len(t) - o_orderkey % 4 + 1] END, ' ') AS node FROM p), n AS (SELECT node, array_to_string(list_sort(list(token)), ' ') AS next FROM e GROUP BY node)
SELECT o_orderkey, coalesce(next, '</s>') AS next FROM q LEFT JOIN n USING (node)""")
def tree_rules(spark, d):
    """What may follow a begun name: whole names, names cut short and names off the tree."""
    names = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    k = F.col("o_orderkey") % 4
    begun = table(spark, d, "orders").join(names, F.col("p_partkey") == F.col("o_custkey") % 2000 + 1)
    cut = F.when(k == 0, F.array_append("t", F.lit("nowhere"))).when(k == 1, F.col("t")).otherwise(F.slice("t", F.lit(1), F.greatest(F.size("t") - k.cast("int") + 1, F.lit(0))))
    out = walking.allowed(begun.select("o_orderkey", cut.alias("tokens")), walking.tree(names.select(F.col("t").alias("tokens"))), "o_orderkey")
    return out.select("o_orderkey", F.array_join("next", " ").alias("next"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) // 40)::BIGINT AS batch, ((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1) % 40)::INT AS place FROM orders")
def reading_batches(spark, d):
    """Orders in batches of 40, the dearest first."""
    return numbering.batched(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "batch", "place")

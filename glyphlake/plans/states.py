"""Registered queries of running states, pictures as bytes, pairing in rounds, streamed replies and score summaries, with SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate, matching, payload
from ..session import shared, table
from ..sources import pictures
from ..streaming import running
from .catalog import query

_FOLD = """v AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value FROM events),
f AS (SELECT key, n, 1::BIGINT AS seen, (value IS NOT NULL)::BIGINT AS k, value AS held, value AS best, 0::BIGINT AS misses FROM v WHERE n = 1
UNION ALL SELECT f.key, v.n, seen + 1, k + (value IS NOT NULL)::BIGINT, CASE WHEN value IS NULL THEN held WHEN held IS NULL THEN value ELSE least(0.9, k / (9.0 + k)) * held + (1 - least(0.9, k / (9.0 + k))) * value END,
  CASE WHEN value IS NULL THEN best WHEN best IS NULL OR value > best THEN value ELSE best END, CASE WHEN value IS NULL THEN misses WHEN best IS NULL OR value > best THEN 0 ELSE misses + 1 END FROM f JOIN v ON v.key = f.key AND v.n = f.n + 1)
SELECT key, max(seen) AS seen, max(k) AS k, round(max_by(held, n), 9) AS held, max_by(best, n) AS best, max_by(misses, n) AS misses FROM f GROUP BY key"""


@query(f"WITH RECURSIVE {_FOLD}")
def streamed_state(spark, d):
    """Every user's running state, kept by a stream over the events' files and read when it has taken them all."""
    import uuid

    where = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, running.PROVIDER)
    try:
        rows = running.running(stream, "user_id", ["ts", "event_id"], "value")
        put = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/b={n}")
        rows.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    told = spark.read.parquet(f"{where}/out")
    last = told.groupBy("key").agg(F.max_by(F.struct("seen", "k", "held", "best", "misses"), "batch").alias("s"))
    return last.select("key", "s.seen", "s.k", F.round("s.held", 9).alias("held"), "s.best", "s.misses")


@query(f"WITH RECURSIVE {_FOLD}")
def folded_state(spark, d):
    """The same from the whole table."""
    out = running.folded(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return out.withColumn("held", F.round("held", 9))


@query("""WITH p AS (SELECT vec_id, vec_id % 8 + 1 AS turn, len(embedding) // 8 AS tall, i // 8 AS y, i % 8 AS x, floor(abs(embedding[i + 1]::DOUBLE) * 255)::BIGINT % 256 AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 8 * 8)) AS i FROM embeddings)),
q AS (SELECT vec_id, turn, CASE WHEN turn < 5 THEN tall ELSE 8 END AS h, CASE WHEN turn < 5 THEN 8 ELSE tall END AS w, v, CASE turn WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN tall - 1 - y WHEN 4 THEN tall - 1 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x ELSE 7 - x END AS b,
  CASE turn WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN tall - 1 - y WHEN 7 THEN tall - 1 - y ELSE y END AS a FROM p)
SELECT vec_id AS page, turn::INT AS turn, h::INT AS h, w::INT AS w, sum((b * w + a + 1) * v)::BIGINT AS sum FROM q GROUP BY ALL""")
def upright_pictures(spark, d):
    """Vectors as grey pictures of 8 pixels a row, written as PNGs that ask to be turned, read back upright."""
    grey = F.transform(F.col("embedding").cast("array<double>"), lambda x: (F.floor(F.abs(x) * 255) % 256).cast("int"))
    tall = F.floor(F.size("embedding") / 8).cast("int")
    pix = F.unhex(F.array_join(F.transform(F.slice(grey, 1, tall * 8), lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    pages = table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), tall.alias("h"), F.lit(8).alias("w"), pix.alias("pix"), (F.col("vec_id") % 8 + 1).cast("int").alias("tag"))
    got = pictures.read(pictures.write(pages, "tag"))
    values = F.transform(F.split(F.regexp_replace(F.hex("pix"), "(..)", "$1 "), " "), lambda x, i: F.coalesce(F.conv(F.nullif(x, F.lit("")), 16, 10).cast("long"), F.lit(0)) * (i + 1))
    return got.select("page", "turn", "h", "w", F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x).alias("sum"))


def _alike(a, b):
    return F.round(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 9)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, role, left(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g'), 60) AS text FROM conversations), g AS (SELECT * FROM t WHERE role = 'user'), w AS (SELECT * FROM t WHERE role = 'assistant'),
p AS (SELECT g.conv_id, g.turn AS i, w.turn AS j, round(1.0 - levenshtein(g.text, w.text) / greatest(length(g.text), length(w.text), 1), 9) AS score FROM g JOIN w USING (conv_id)),
r AS (SELECT DISTINCT conv_id, []::BIGINT[] AS i, []::BIGINT[] AS j, []::DOUBLE[] AS s FROM p UNION ALL
  SELECT conv_id, i, j, s FROM (SELECT r.conv_id, list_append(r.i, p.i) AS i, list_append(r.j, p.j) AS j, list_append(r.s, p.score) AS s, row_number() OVER (PARTITION BY r.conv_id ORDER BY p.score DESC, p.i DESC, p.j DESC) AS k FROM r JOIN p ON r.conv_id = p.conv_id AND NOT list_contains(r.i, p.i) AND NOT list_contains(r.j, p.j)) WHERE k = 1),
e AS (SELECT conv_id, unnest(i) AS i, unnest(j) AS j, unnest(s) AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY len(i) DESC) AS k FROM r) WHERE k = 1)
SELECT w.conv_id, w.turn AS truth_pos, e.i AS read_pos, coalesce(e.s, 0) AS score FROM w LEFT JOIN e ON e.conv_id = w.conv_id AND e.j = w.turn""")
def greedy_rounds(spark, d):
    """Users' turns paired with the answers of their conversation, by edits over the first 60 letters."""
    talk = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "role", F.left(T.ascii_fold(F.coalesce("text", F.lit(""))), F.lit(60)).alias("text"))
    out = matching.greedy_pairs(talk.where("role = 'user'"), talk.where("role = 'assistant'"), "conv_id", _alike)
    return out.select("conv_id", "truth_pos", "read_pos", "score")


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant'), l AS (SELECT conv_id, turn, 0 AS n, concat('{"model":"m","message":{"role":"assistant","content":', to_json(text), '},"done":false}', chr(10)) AS line FROM t WHERE text <> ''
UNION ALL SELECT conv_id, turn, (text <> '')::INT, concat('{"model":"m","message":{"role":"assistant","content":""},"done":true,"done_reason":"stop"}', chr(10)) FROM t) SELECT conv_id, turn, n, line FROM l""")
def streamed_replies(spark, d):
    return payload.ndjson(table(spark, d, "conversations").where("role = 'assistant'"), ["conv_id", "turn"], "m")


@query("""WITH s AS (SELECT lang, source, round(avg(n_chars) / 100.0, 6) AS score FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score, source) AS r, count(*) OVER (PARTITION BY lang) AS n FROM s)
SELECT lang, max(n) AS n, min(score) AS lowest, max(score) FILTER (WHERE r = n // 10 + 1) AS tenth, round(median(score), 6) AS middle, round(avg(score), 6) AS mean, string_agg(source, ' ' ORDER BY r) FILTER (WHERE r <= 5) AS worst FROM r GROUP BY lang""")
def score_summary(spark, d):
    """A language's sources by their mean length: the lowest, the tenth part's, the middle, the mean and the five lowest names."""
    scores = table(spark, d, "documents").groupBy("lang", "source").agg(F.round(F.avg("n_chars") / 100.0, 6).alias("score"))
    out = aggregate.summary(scores, ["lang"], "source", "score")
    return out.select("lang", "n", "lowest", "tenth", F.round("middle", 6).alias("middle"), F.round("mean", 6).alias("mean"), F.array_join(F.transform("worst", lambda x: x["name"]), " ").alias("worst"))

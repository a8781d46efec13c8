"""Registered queries of small decisions and of pixel measures, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pixels, rules, sampling
from ..session import table
from .catalog import query

_FONT = "concat(o_orderpriority, ' ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN concat(' Face', o_orderkey, '-Bold') ELSE '' END, '.ttf')"


@query(f"""WITH n AS (SELECT o_orderkey, {_FONT} AS name FROM orders), b AS (SELECT *, string_split(replace(name, '.ttf', ''), ' ') AS b FROM n)
SELECT o_orderkey, CASE WHEN len(b) >= 3 THEN concat(b[2], ' (', split_part(b[len(b)], '-', 1), ')') ELSE name END AS short FROM b""")
def short_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.short_name(F.expr(_FONT)).alias("short"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE p_name END AS head, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '' END AS rest FROM part")
def first_space_split(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.parted(F.col("p_name")).alias("p")).select("p_partkey", "p.head", "p.rest")


@query("""WITH c AS (SELECT event_id, concat('https://e.com/', event_type, ' ', props, '+é?a=', value) AS url FROM events)
SELECT event_id, array_to_string(list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~:/@%?=&-]$') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS quoted, true AS back FROM c""")
def percent_quote(spark, d):
    url = F.concat(F.lit("https://e.com/"), "event_type", F.lit(" "), "props", F.lit("+é?a="), F.col("value").cast("string"))
    rows = table(spark, d, "events").select("event_id", url.alias("url")).withColumn("quoted", rules.quoted(F.col("url")))
    return rows.select("event_id", "quoted", (rules.unquoted(F.col("quoted")) == F.col("url")).alias("back"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), '\\s+', '', 'g') AS tight FROM documents")
def tight_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tight(T.nfd_hangul(T.ascii_fold(F.col("text")))).alias("tight"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '[1]' ELSE list_filter(range(3, 23), lambda i: i % (2 + c_custkey % 5) <> 0)::VARCHAR END AS keep FROM customer")
def allowed_tokens(spark, d):
    every = F.sequence(F.lit(0), F.lit(22))
    banned = F.filter(every, lambda i: (i < 3) | (i % (2 + F.col("c_custkey") % 5) == 0))
    keep = rules.allowed(every, banned, F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(2), 1)
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("["), F.array_join(keep, ", "), F.lit("]")).alias("keep"))


@query("WITH m AS (SELECT vec_id, list_filter(list_transform(range(len(embedding)), lambda i: CASE WHEN i % 7 NOT IN (0, 3) THEN embedding[i + 1]::DOUBLE END), lambda x: x IS NOT NULL) AS m FROM embeddings) SELECT vec_id, round(list_max(m), 6) AS best FROM m")
def ban_mask(spark, d):
    x = F.col("embedding").cast("array<double>")
    keep = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: ~(i % 7).isin(0, 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(rules.masked(x, keep)), 6).alias("best"))


@query("SELECT s_suppkey, (CASE WHEN (s_suppkey * 37) % 64 < 32 THEN (3735928559 >> ((s_suppkey * 37) % 32)::INT) & 1 ELSE 0 END) = 1 AS has FROM supplier")
def coverage_bitmap(spark, d):
    # 0xDEADBEEF with its lowest byte first; bits from 32 on are beyond the map
    cover = F.unhex(F.lit("EFBEADDE"))
    return table(spark, d, "supplier").select("s_suppkey", rules.has_bit(cover, (F.col("s_suppkey") * 37 % 64).cast("int")).alias("has"))


@query("SELECT conv_id, turn, len(string_split(text, ' ')) + 2 <= 34 AS fits, len(string_split(text, ' ')) >= 40 AND NOT list_contains(string_split(text, ' '), 'end.') AS capped FROM conversations")
def length_limits(spark, d):
    words = F.split("text", " ")
    ids = F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>")))
    return table(spark, d, "conversations").select("conv_id", "turn", rules.fits(ids, 34).alias("fits"), ((F.size(words) >= 40) & ~F.array_contains(words, "end.")).alias("capped"))


@query("""WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::BIGINT) AS l FROM documents),
s AS (SELECT doc_id, list_prepend(1, l[1:len(l) - 1]) AS s FROM t)
SELECT doc_id, list_sum(list_transform(range(len(s)), lambda i: CASE WHEN i > 0 AND s[i + 1] <> 0 AND (i * 7919 + doc_id) % 100 < 15 THEN 3 + (i * 31 + doc_id) % 50 ELSE s[i + 1] END))::BIGINT AS total FROM s""")
def blurred_inputs(spark, d):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    rows = table(spark, d, "documents").select("doc_id", lengths.alias("l"))
    at = F.sequence(F.lit(0).cast("long"), F.size("l").cast("long") - 1)
    from ..functions import arrays as A

    out = rules.blurred(A.shift_right(F.col("l"), 1, 0), F.transform(at, lambda i: ((i * 7919 + F.col("doc_id")) % 100) / 100.0), F.transform(at, lambda i: 3 + (i * 31 + F.col("doc_id")) % 50), 0.15, 0)
    return rows.select("doc_id", F.aggregate(out, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_PARAM = "concat(CASE WHEN l_linenumber % 2 = 0 THEN 'encoder.' ELSE 'decoder.' END, 'layer.', l_suppkey, CASE l_partkey % 3 WHEN 0 THEN '.bias' WHEN 1 THEN '.LayerNorm.weight' ELSE '.weight' END)"


@query(f"""WITH p AS (SELECT {_PARAM} AS name, 1 + l_partkey % 2 AS dims FROM lineitem)
SELECT concat(CASE WHEN starts_with(name, 'encoder.') THEN 'encoder' ELSE 'decoder' END, CASE WHEN dims <= 1 OR name LIKE '%.bias' OR lower(name) LIKE '%layernorm%' THEN '/plain' ELSE '/decay' END) AS grp, count(*) AS n FROM p GROUP BY ALL""")
def parameter_groups(spark, d):
    rows = table(spark, d, "lineitem").select(F.expr(_PARAM).alias("name"), (1 + F.col("l_partkey") % 2).alias("dims"))
    return rows.groupBy(rules.parameter_group(F.col("name"), F.col("dims")).alias("grp")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round(least(7.6, 1.35 * pow(p_size, 0.613) * exp(0.2 * (p_retailprice % 7 - 3))), 6) AS aspect FROM part")
def aspect_target(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(rules.aspect(F.col("p_size"), F.col("p_retailprice") % 7 - 3, 0.2), 6).alias("aspect"))


@query("""WITH b AS (SELECT o_orderkey, o_custkey % 120 AS tall, o_custkey % 300 AS wide, (o_orderkey % 40) / 100.0 AS density FROM orders)
SELECT o_orderkey, tall * wide > 0 AND tall >= 18 AND tall <= 300 AND wide >= 0.5 * tall AND density >= 0.015 AND density <= 0.25 AS worth FROM b""")
def worth_reading(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 120).alias("tall"), (F.col("o_custkey") % 300).alias("wide"), ((F.col("o_orderkey") % 40) / 100.0).alias("density"))
    return rows.select("o_orderkey", rules.worth_reading(F.col("tall"), F.col("wide"), F.col("density"), F.lit(1000)).alias("worth"))


_TIMED = "SELECT l_suppkey AS side, l_linenumber AS batch, round(avg(l_extendedprice), 2) AS per_line, max(l_quantity) > 49 AS spilled, max(l_extendedprice) AS peak FROM lineitem GROUP BY l_suppkey, l_linenumber"


def _timed(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("side"), F.col("l_linenumber").alias("batch")).agg(F.round(F.avg("l_extendedprice"), 2).alias("per_line"), (F.max("l_quantity") > 49).alias("spilled"), F.max("l_extendedprice").alias("peak"))


@query(f"WITH t AS ({_TIMED}) SELECT side, batch, per_line FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY per_line, batch) AS k FROM t WHERE NOT spilled AND per_line > 0) WHERE k = 1")
def cheapest_batch(spark, d):
    return rules.cheapest(_timed(spark, d), ["side"], "batch", "per_line", "spilled")


@query(f"""WITH t AS ({_TIMED}), l AS (SELECT *, lag(peak) OVER (PARTITION BY side ORDER BY batch) AS last FROM t)
SELECT side, batch, round(CASE WHEN last IS NOT NULL THEN 9000 + 2 * greatest(0, last - 9000) END, 4) AS guess, coalesce(last > 0 AND 9000 + 2 * greatest(0, last - 9000) > 0.9 * 60000, false) AS skip FROM l""")
def spill_prediction(spark, d):
    out = rules.spills(_timed(spark, d), ["side"], "batch", "peak", F.lit(9000.0), F.lit(60000.0))
    return out.select("side", "batch", F.when(F.lag("peak").over(Window.partitionBy("side").orderBy("batch")).isNotNull(), F.round("guess", 4)).alias("guess"), "skip")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 6")
def bottom_k(spark, d):
    return rules.lowest(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 6, "c_acctbal", "c_custkey")


_ORDER = ("URGENT", "FURNITURE", "BUILDING")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'URGENT' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 99 END AS place FROM customer")
def declared_order(spark, d):
    return rules.declared(table(spark, d, "customer"), "c_mktsegment", _ORDER).select("c_custkey", "place")


@query("SELECT source, round(avg(n_chars), 6) AS mean, row_number() OVER (ORDER BY avg(n_chars), source)::INT AS at FROM documents GROUP BY source HAVING avg(n_chars) < 4000")
def below_goal(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("m")).where("m < 4000")
    # one row a source
    return rows.select("source", F.round("m", 6).alias("mean"), F.row_number().over(Window.orderBy("m", "source")).alias("at"))


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn + 1) FROM conversations WHERE role = 'user')")
def leftover_reads(spark, d):
    talk = table(spark, d, "conversations")
    taken = talk.where("role = 'user'").select("conv_id", (F.col("turn") + 1).cast(talk.schema["turn"].dataType).alias("turn"))
    return rules.leftovers(talk.select("conv_id", "turn"), taken, ["conv_id", "turn"])


@query("""WITH c AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), t AS (SELECT conv_id, 2 * count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT c.conv_id, c.turn, (CASE WHEN c.conv_id % 3 = 0 AND t.n = c.n THEN c.n - 1 - c.turn ELSE c.turn END)::BIGINT AS place FROM c LEFT JOIN t USING (conv_id)""")
def cell_order_override(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    truths = talk.where("role = 'user'").select("conv_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    n = talk.groupBy("conv_id").agg(F.count("*").alias("n"))
    turns = talk.where("conv_id % 3 = 0").join(n, "conv_id").select("conv_id", "turn", (F.col("n") - 1 - F.col("turn")).alias("place"))
    return rules.reordered(talk.select("conv_id", "turn"), turns, truths, "conv_id", "turn").select("conv_id", "turn", "place")


@query("WITH t AS (SELECT p_partkey, list_sort(string_split(p_name, ' ')) AS m FROM part) SELECT min(p_partkey) AS p_partkey FROM t GROUP BY m")
def team_dedupe(spark, d):
    return rules.teams(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("m")), "m", "p_partkey").select("p_partkey")


@query("WITH p AS (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS s, count(o_totalprice) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, round(sum(s) / sum(n), 4) AS by_line, round(avg(s / n), 4) AS by_photo FROM p GROUP BY o_orderpriority")
def weighted_means(spark, d):
    out = rules.weighed(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", "o_totalprice")
    return out.select("o_orderpriority", F.round("by_line", 4).alias("by_line"), F.round("by_photo", 4).alias("by_photo"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS hit FROM events), r AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id, event_id, sum((NOT hit)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS misses, sum((NOT hit)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) > 5 AS stop FROM r""")
def miss_counter(spark, d):
    return rules.fruitless(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error", 5).select("user_id", "event_id", "misses", "stop")


@query("SELECT s_suppkey, (s_nationkey % 2 + (s_suppkey % 3 = 0)::INT)::INT AS unknown FROM supplier")
def unknown_options(spark, d):
    known = F.array(*[F.lit(k) for k in range(0, 100, 2)])
    asked = F.array(F.col("s_nationkey").cast("int"), F.when(F.col("s_suppkey") % 3 == 0, -1).otherwise(0))
    return table(spark, d, "supplier").select("s_suppkey", F.size(F.array_except(asked, known)).alias("unknown"))


_PIX = """p AS (SELECT vec_id AS cell, (i // 8)::INT AS y, (i % 8)::INT AS x, least(255, floor(abs(embedding[i + 1]::DOUBLE) * 1000))::INT AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"""


def _pixels(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    return rows.select("cell", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.least(F.lit(255), F.floor(F.abs("e") * 1000)).cast("int").alias("v"))


@query(f"""WITH {_PIX}, s AS (SELECT cell, count(*) AS total, count(*) FILTER (WHERE v < 60) AS inked, count(*) FILTER (WHERE v >= 60 AND v < 236) AS pale, min(x) FILTER (WHERE v < 60) AS l, min(y) FILTER (WHERE v < 60) AS t, max(x) FILTER (WHERE v < 60) AS r, max(y) FILTER (WHERE v < 60) AS b FROM p GROUP BY cell),
h AS (SELECT cell, v, sum(count(*)) OVER (PARTITION BY cell ORDER BY v) AS upto, sum(count(*)) OVER (PARTITION BY cell) AS n FROM p WHERE v < 60 GROUP BY cell, v),
k AS (SELECT cell, min(v) FILTER (WHERE upto >= 0.1 * n) AS dark10, min(v) FILTER (WHERE upto >= 0.5 * n) AS mid FROM h GROUP BY cell)
SELECT cell, round(inked / total, 6) AS ink, round(inked / ((r - l + 1) * (b - t + 1)), 6) AS density, CASE WHEN inked >= 10 THEN dark10 END AS dark10, CASE WHEN inked >= 10 THEN mid END AS mid, CASE WHEN inked >= 10 THEN round(pale / inked, 6) END AS fringe FROM s LEFT JOIN k USING (cell)""")
def cell_facts(spark, d):
    out = pixels.facts(_pixels(spark, d), 60, least=10)
    return out.select("cell", *[F.round(c, 6).alias(c) for c in ("ink", "density")], "dark10", "mid", F.round("fringe", 6).alias("fringe"))


@query(f"""WITH {_PIX}, s AS (SELECT cell, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM p WHERE v < 20 GROUP BY cell)
SELECT cell, round((t + 8 - b - 1) / 2 / (b + 1 - t), 6) AS edge_up, round((l + 8 - r - 1) / 2 / (b + 1 - t), 6) AS edge_side FROM s""")
def cell_margins(spark, d):
    return pixels.margins(_pixels(spark, d), 20).select("cell", F.round("edge_up", 6).alias("edge_up"), F.round("edge_side", 6).alias("edge_side"))


@query(f"""WITH {_PIX}, c AS (SELECT DISTINCT cell, x FROM p WHERE v < 20), g AS (SELECT *, x - row_number() OVER (PARTITION BY cell ORDER BY x) AS run FROM c),
r AS (SELECT cell, count(*) AS wide, min(x) AS s FROM g GROUP BY cell, run), o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY wide, s) - 1 AS k, count(*) OVER (PARTITION BY cell) AS n FROM r),
t AS (SELECT cell, max(y) - min(y) + 1 AS tall FROM p WHERE v < 20 GROUP BY cell)
SELECT cell, round(CASE WHEN tall < 5 THEN 0 ELSE wide / tall END, 6) AS blob FROM o JOIN t USING (cell) WHERE k = n // 2""")
def blob_width(spark, d):
    return pixels.blobs(_pixels(spark, d), 20, 5).select("cell", F.round("blob", 6).alias("blob"))


@query(f"""WITH {_PIX}, b AS (SELECT DISTINCT cell, y + dy AS y, x + dx AS x, 1 AS hit FROM p CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) WHERE v >= 128),
w AS (SELECT cell, count(*) AS area, count(b.hit) AS eaten, max(y) - min(y) + 1 AS tall FROM (SELECT * FROM p WHERE v < 128) p LEFT JOIN b USING (cell, y, x) GROUP BY cell) SELECT cell, round(CASE WHEN eaten = 0 THEN 0 ELSE 2 * area / eaten / tall END, 6) AS stroke FROM w""")
def stroke_thickness(spark, d):
    return pixels.strokes(_pixels(spark, d)).select("cell", F.round("stroke", 6).alias("stroke"))


def _hashes(n: int, row: str) -> str:
    """SQL list of n integer hashes of a row number: those of aggregate.mixed."""
    step = lambda e: f"list_transform({e}, lambda x: (x * 16807 + (x >> 16)) % 2147483647)"
    return step(step(step(f"list_transform(range({n}), lambda k: (({row} % 2147483647 + 1) * 48271 + k * 69621 + (({row} % 2147483647 + 1) >> 12)) % 2147483647)")))


def _one(options, k: int) -> str:
    return f"{list(options)!r}[h[{k + 1}] % {len(options)} + 1]"


def _digits(k: int, lo: int, hi: int, width: int) -> str:
    return f"lpad((h[{k + 1}] % {hi - lo + 1} + {lo})::VARCHAR, {width}, '0')"


_MADE = f"{_one(sampling.HEADS, 2)}, {_one(sampling.TAILS, 3)}"
_VALUE = f"""CASE kind WHEN 'name' THEN concat({_MADE}, {_one(sampling.TAILS, 4)}) WHEN 'org' THEN concat({_MADE}, {_one(sampling.UNITS, 4)})
 WHEN 'doc' THEN concat({_one(sampling.PAPERS, 4)}, ' ', {_digits(5, 1, 9999, 4)}, '-', {_digits(6, 1, 99, 2)})
 WHEN 'date' THEN concat({_digits(4, 2001, 2030, 4)}, '-', {_digits(5, 1, 12, 2)}, '-', {_digits(6, 1, 28, 2)})
 WHEN 'slot' THEN concat({_digits(4, 0, 23, 2)}, ':', {_digits(5, 0, 59, 2)}, '~', {_digits(6, 0, 23, 2)}, ':', {_digits(7, 0, 59, 2)})
 WHEN 'latin' THEN concat({_one(sampling.LATIN, 4)}, {_one(sampling.ENDS, 5)}, ' ', {_digits(6, 1, 99, 2)})
 ELSE concat({_MADE}, '에서 ', {_one(sampling.HEADS, 4)}, {_one(sampling.TAILS, 5)}, '과 ', {_one(sampling.HEADS, 6)}, {_one(sampling.TAILS, 7)}, ' ', {_one(sampling.PAPERS, 8)}, '를 함께 읽는다.') END"""


@query(f"""WITH n AS (SELECT pos, {_hashes(sampling.CHOICES, 'pos')} AS h FROM (SELECT o_orderkey::BIGINT AS pos FROM orders)),
k AS (SELECT *, {_one(sampling.VALUES, 1)} AS kind FROM n), v AS (SELECT *, {_VALUE} AS v FROM k),
l AS (SELECT *, CASE WHEN kind = 'sentence' THEN v ELSE concat({_one(sampling.FIELDS, 9)}, {_one(sampling.BETWEEN, 10)}, v) END AS line, h[12] % 16 AS mark FROM v)
SELECT pos, kind, CASE mark WHEN 0 THEN concat('(', line, ')') WHEN 1 THEN concat(line, '!') WHEN 2 THEN concat('- ', line) ELSE line END AS text FROM l""")
def generated_forms(spark, d):
    return sampling.forms(table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k")), "k")


@query(f"""WITH f AS (SELECT list({{'font': 'f' || i, 'm': i + 2, 'full': i > 5}} ORDER BY i) AS fonts FROM (SELECT unnest(range(9)) AS i)),
l AS (SELECT p_partkey AS pos, p_partkey % 60 AS need, {_hashes(7, 'p_partkey::BIGINT')} AS h FROM part),
r AS (SELECT pos, h, fonts, list_filter(list_transform(h[1:6], lambda x: fonts[x % 9 + 1]), lambda f: need % f.m = 0) AS tried, list_filter(fonts, lambda f: f.full) AS base, list_filter(fonts, lambda f: f.full AND need % f.m = 0) AS able, need FROM l CROSS JOIN f),
c AS (SELECT pos, need, CASE WHEN len(tried) > 0 THEN tried[1] WHEN len(able) > 0 THEN able[h[7] % len(able) + 1] ELSE base[h[7] % len(base) + 1] END AS f FROM r)
SELECT pos, f.font AS font, need % f.m = 0 AS covered FROM c""")
def coverage_pick(spark, d):
    """A part needs one letter; font i draws the letters that i + 2 divides."""
    letters = F.array(*[F.lit(k) for k in range(60)])
    fonts = spark.range(9).select(F.concat(F.lit("f"), "id").alias("font"), F.filter(letters, lambda k: k % (F.col("id") + 2) == 0).alias("glyphs"), (F.col("id") > 5).alias("full"))
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.array((F.col("p_partkey") % 60).cast("int")).alias("chars"))
    return sampling.covered_pick(lines, fonts)

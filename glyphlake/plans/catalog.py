"""Registered queries of the library's own operators, each with SQL for the same rows where SQL can express it.

Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import aggregate, matching, payload, reading, sampling, segment, sequence
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of whole documents, non-ASCII folded: (doc_id, source, lang, text, read), read being the one before, paired
    inside the row."""
    parts = F.filter(F.split(T.ascii_fold(F.col("text")), r"[.\n]"), lambda x: x != "")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", parts.alias("p"))
    before = F.concat(F.array(F.lit("")), F.col("p"))
    return docs.select("doc_id", "source", "lang", F.inline(F.filter(F.arrays_zip(F.col("p").alias("text"), before.alias("read")), lambda x: x["text"].isNotNull())))


_SENTENCES = r"""
s AS (SELECT doc_id, source, lang, unnest(range(len(p))) AS pos, unnest(p) AS text FROM (SELECT doc_id, source, lang, string_split_regex(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '[.\n]') AS p FROM documents)),
r AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY pos), '') AS read FROM s WHERE text <> ''),
t AS (SELECT *, regexp_replace(read, '\s+', '', 'g') AS a, regexp_replace(text, '\s+', '', 'g') AS b FROM r),
m AS (SELECT source, lang, levenshtein(a, b) AS edits, length(b) AS chars, (a = b AND b <> '')::INT AS exact,
  CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(text, '[0-9]') THEN 'digits' WHEN contains(text, ':') THEN 'label' WHEN length(b) <= 6 THEN 'word' ELSE 'sentence' END AS kind,
  CASE WHEN length(b) <= 5 THEN '1-5' WHEN length(b) <= 10 THEN '6-10' WHEN length(b) <= 20 THEN '11-20' ELSE '21+' END AS span FROM t)"""
_ROLL = "count(*) AS lines, sum(chars)::BIGINT AS chars, round(100.0 * sum(edits) / greatest(sum(chars), 1), 6) AS cer, round(100.0 * avg(exact), 6) AS exact"


@query(f"WITH {_SENTENCES} SELECT kind, span, {_ROLL} FROM m GROUP BY GROUPING SETS ((kind), (span), (kind, span), ())")
def cer_rollup_by_kind_span(spark, d):
    marked = aggregate.marks(_sentences(spark, d)).withColumns({"kind": T.kind(F.col("text")), "span": T.span(F.col("text"))})
    return aggregate.roll_by(marked, [["kind"], ["span"], ["kind", "span"], []])


@query(f"WITH {_SENTENCES} SELECT source, lang, {_ROLL} FROM m GROUP BY GROUPING SETS ((source, lang), (lang), ())")
def rollup_font_herd_total(spark, d):
    return aggregate.roll_by(aggregate.marks(_sentences(spark, d)), [["source", "lang"], ["lang"], []])


_SCORE = "least(100.0, n_chars / 40.0)"


@query(f"""WITH g AS (SELECT DISTINCT lang FROM documents), b AS (SELECT unnest([0,50,60,70,80,85,90,95])::DOUBLE AS lo, unnest([50,60,70,80,85,90,95,101])::DOUBLE AS hi)
SELECT g.lang, lo, hi, (SELECT count(*) FROM documents d WHERE d.lang = g.lang AND {_SCORE} >= lo AND {_SCORE} < hi) AS n FROM g CROSS JOIN b""")
def score_histogram(spark, d):
    return aggregate.histogram(table(spark, d, "documents").select("lang", F.least(F.lit(100.0), F.col("n_chars") / 40.0).alias("score")), ["lang"], "score")


def _trusts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    trust = F.when(F.col("n_chars") % 17 == 0, None).when(F.col("n_chars") % 13 == 0, -1.0).otherwise((F.col("n_chars") % 100) / 100.0)
    return docs.select(F.col("lang").alias("team"), trust.alias("trust"), F.when(F.col("quality") == 1, 1.0 - (F.col("doc_id") % 10) / 100.0).otherwise(0.5).alias("close"))


_TRUSTS = """t AS (SELECT lang AS team, CASE WHEN n_chars % 17 = 0 THEN NULL WHEN n_chars % 13 = 0 THEN -1.0 ELSE (n_chars % 100) / 100.0 END AS trust, CASE WHEN quality = 1 THEN 1.0 - (doc_id % 10) / 100.0 ELSE 0.5 END AS close FROM documents JOIN labels USING (doc_id)),
g AS (SELECT unnest([0, .50, .60, .65, .70, .75, .80, .85, .90, .95])::DOUBLE AS edge),
s AS (SELECT team, edge, trust IS NOT NULL AND trust >= 0 AND trust < edge AS gone, close >= 0.95 AS good, close FROM t CROSS JOIN g),
w AS (SELECT team, edge, sum((gone AND good)::INT)::BIGINT AS miss, sum((gone AND NOT good)::INT)::BIGINT AS block, sum((NOT gone AND NOT good)::INT)::BIGINT AS leak, round(avg(CASE WHEN gone THEN 0.0 ELSE close END), 6) AS accuracy FROM s GROUP BY ALL)"""


@query(f"WITH {_TRUSTS} SELECT * FROM w")
def trust_sweep(spark, d):
    return aggregate.sweep(_trusts(spark, d), ["team"])


@query(f"WITH {_TRUSTS}, e AS (SELECT team, max(edge) AS edge FROM w WHERE miss = 0 GROUP BY team) SELECT team, edge, min(edge) OVER () AS overall FROM e")
def safe_threshold(spark, d):
    edges = aggregate.safe_edge(aggregate.sweep(_trusts(spark, d), ["team"]), ["team"])
    return edges.join(F.broadcast(edges.agg(F.min("edge").alias("overall"))))


@query(f"WITH {_TRUSTS} SELECT team, sum((trust >= 0 AND trust < 0.8 AND close < 0.9)::INT)::BIGINT AS blocked, sum((trust >= 0 AND trust < 0.8 AND close >= 0.9)::INT)::BIGINT AS missed, count(*) FILTER (WHERE NOT coalesce(trust >= 0 AND trust < 0.8, false) AND close < 0.9) AS leaked, count(*) FILTER (WHERE NOT coalesce(trust >= 0 AND trust < 0.8, false) AND close >= 0.9) AS kept FROM t GROUP BY team")
def trust_confusion(spark, d):
    unsure = F.coalesce((F.col("trust") >= 0) & (F.col("trust") < reading.EDGE), F.lit(False))
    good = F.col("close") >= 0.9
    n = lambda c: F.count(F.when(c, 1))
    return _trusts(spark, d).groupBy("team").agg(n(unsure & ~good).alias("blocked"), n(unsure & good).alias("missed"), n(~unsure & ~good).alias("leaked"), n(~unsure & good).alias("kept"))


_QS = "[0.015, 0.10, 0.25, 0.50, 0.75, 0.90, 0.985]"


@query(f"""WITH o AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
q AS (SELECT unnest({_QS})::DOUBLE AS q)
SELECT l_returnflag, q, n, l_extendedprice AS value FROM o CROSS JOIN q WHERE r = least(n - 1, floor(n * q)::BIGINT)""")
def floor_quantiles(spark, d):
    return aggregate.ranked_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS least, max(value) FILTER (WHERE r = n // 4) AS quarter, round(median(value), 6) AS middle FROM o GROUP BY event_type""")
def five_number_spread(spark, d):
    rows = table(spark, d, "events")
    quarter = aggregate.ranked_quantiles(rows, ["event_type"], "value", [0.25]).select("event_type", F.col("value").alias("quarter"))
    return rows.groupBy("event_type").agg(F.min("value").alias("least"), F.round(F.percentile("value", 0.5), 6).alias("middle")).join(quarter, "event_type")


@query("""WITH p AS (SELECT lang, ln(n_chars) AS x, ln(length(text) - length(replace(text, ' ', '')) + 1) AS y FROM documents WHERE n_chars > 0),
f AS (SELECT lang, count(*) AS n, regr_slope(y, x) AS p, regr_intercept(y, x) AS i FROM p GROUP BY lang),
o AS (SELECT lang, n, exp(y - i - f.p * x) AS e, row_number() OVER (PARTITION BY lang ORDER BY y - i - f.p * x) - 1 AS r FROM p JOIN f USING (lang))
SELECT f.lang, f.n, round(exp(any_value(i)), 3) AS a, round(any_value(f.p), 3) AS p, round(max(e) FILTER (WHERE r = f.n // 10), 2) AS low, round(max(e) FILTER (WHERE r = 9 * f.n // 10), 2) AS high FROM f JOIN o USING (lang) GROUP BY f.lang, f.n""")
def loglog_fit(spark, d):
    rows = table(spark, d, "documents").select("lang", F.col("n_chars").alias("x"), (F.length("text") - F.length(F.regexp_replace("text", " ", "")) + 1).alias("y"))
    return aggregate.loglog(rows, ["lang"], "x", "y")


@query(f"""WITH q AS (SELECT unnest({_QS})::DOUBLE AS q),
a AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS r, count(*) OVER () AS n FROM documents),
w AS (SELECT q, n_chars AS want FROM a CROSS JOIN q WHERE r = least(n - 1, floor(n * q)::BIGINT)),
g AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
v AS (SELECT lang, q, n_chars AS value FROM g CROSS JOIN q WHERE r = least(n - 1, floor(n * q)::BIGINT)),
z AS (SELECT greatest(max_by(want, q) - min_by(want, q), 0.2 * abs(max(want) FILTER (WHERE q = 0.5)), 1e-6) AS span FROM w)
SELECT lang, round(sum(abs(value - want)) / count(*) / any_value(span), 6) AS gap, round(sum(abs(value - want)) / count(*) / any_value(span), 6) < 0.25 AS ok FROM v JOIN w USING (q) CROSS JOIN z GROUP BY lang""")
def distribution_drift(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("v"))
    want = aggregate.ranked_quantiles(docs, [], "v").select("q", "value")
    return aggregate.drift(aggregate.ranked_quantiles(docs, ["lang"], "v"), want, ["lang"]).withColumn("ok", F.col("gap") < 0.25)


_T = "epoch(date_trunc('second', ts))::BIGINT"


def _seconds(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "value", F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("t"))


_ISLANDS = f"""e AS (SELECT event_id, user_id, value, {_T} AS t FROM events),
f AS (SELECT *, coalesce((t - lag(t) OVER w > 7200)::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT user_id, run, min(t) AS start, max(t) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f) GROUP BY user_id, run)"""


@query(f'WITH {_ISLANDS} SELECT user_id, start, "end", n FROM i')
def islands_events(spark, d):
    return sequence.islands(_seconds(spark, d), ["user_id"], "t", 7200)


@query(f'WITH {_ISLANDS} SELECT user_id, start, "end", n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - start DESC, start) AS k FROM i) WHERE k = 1')
def longest_run(spark, d):
    return sequence.longest_run(_seconds(spark, d), ["user_id"], "t", 7199)


@query(f"""WITH e AS (SELECT user_id, {_T} AS t FROM events),
f AS (SELECT *, coalesce((t - lag(t) OVER w > 3600)::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS (SELECT user_id, run, min(t) AS start, max(t) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM f) GROUP BY user_id, run),
s AS (SELECT *, start - lag("end") OVER (PARTITION BY user_id ORDER BY start) AS space FROM i),
k AS (SELECT user_id, coalesce(max(space) FILTER (WHERE k = 2), 0) AS second FROM (SELECT user_id, space, row_number() OVER (PARTITION BY user_id ORDER BY space DESC NULLS LAST) AS k FROM s) GROUP BY user_id),
g AS (SELECT s.*, sum(coalesce((space > greatest(14400, 2 * second))::INT, 1)) OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS part FROM s JOIN k USING (user_id))
SELECT user_id, min(start) AS start, max("end") AS "end", sum(n)::BIGINT AS n FROM g GROUP BY user_id, part""")
def odd_gap_split(spark, d):
    return sequence.odd_gap_split(_seconds(spark, d), ["user_id"], "t", 14400)


_BOXES = """b AS (SELECT o_orderkey, o_custkey, (epoch(o_orderdate) / 86400)::BIGINT AS top, (epoch(o_orderdate) / 86400)::BIGINT + 30 + o_orderkey % 90 AS bottom FROM orders),
r AS (SELECT *, sum(coalesce((top >= m)::INT, 0)) OVER (PARTITION BY o_custkey ORDER BY top, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS row FROM (SELECT *, max(bottom) OVER (PARTITION BY o_custkey ORDER BY top, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b))"""


def _boxes(spark, d):
    top = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", top.alias("top"), (top + 30 + F.col("o_orderkey") % 90).alias("bottom"))


@query(f"WITH {_BOXES} SELECT o_orderkey, o_custkey, top, bottom, row FROM r")
def overlap_rows(spark, d):
    return sequence.overlap_rows(_boxes(spark, d), ["o_custkey"], "top", "bottom", "o_orderkey")


@query(f"WITH {_BOXES}, a AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, row) AS n FROM r) SELECT o_custkey, o_orderkey, tall FROM (SELECT *, bottom - top AS tall, row_number() OVER (PARTITION BY o_custkey ORDER BY bottom - top DESC, top, o_orderkey) AS k FROM a WHERE n = 1) WHERE k = 1")
def headline(spark, d):
    rows = sequence.overlap_rows(_boxes(spark, d), ["o_custkey"], "top", "bottom", "o_orderkey").withColumn("tall", F.col("bottom") - F.col("top")).withColumn("at", F.struct("top", "o_orderkey"))
    return sequence.headline(rows, ["o_custkey"], "tall", "at").select("o_custkey", "o_orderkey", "tall")


@query("SELECT o_orderkey, o_custkey, best, coalesce(o_totalprice > 1.05 * best, false) AS slower FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM orders)")
def running_best(spark, d):
    return sequence.running_best(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey", "o_custkey", "best", "slower")


_PARTS = """s AS (SELECT p_brand AS name, round(avg(p_size) * 1.5, 6) AS score FROM part GROUP BY p_brand),
w AS (SELECT name, score, 0.5 / count(*) OVER () + 0.5 * greatest(0, 100 - score) / sum(greatest(0, 100 - score)) OVER () AS p FROM s),
c AS (SELECT *, sum(p) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS hi FROM w)"""


def _weights(spark, d):
    scores = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_size") * 1.5, 6).alias("score"))
    return sampling.error_weights(scores, "name", "score")


@query(f"WITH {_PARTS} SELECT name, score, round(p, 9) AS p, round(hi, 9) AS hi FROM c")
def error_weighted_cdf(spark, d):
    return sequence.cumulative(_weights(spark, d), [], "name", "p").select("name", "score", F.round("p", 9).alias("p"), F.round("hi", 9).alias("hi"))


@query(f"WITH {_PARTS}, t AS (SELECT max(hi) AS total FROM c), u AS (SELECT s_suppkey, ((s_suppkey * 7919) % 10007 + 0.5) / 10007.0 AS u FROM supplier) SELECT s_suppkey, name FROM u CROSS JOIN t JOIN c ON u * total >= hi - p AND u * total < hi")
def inverse_cdf_pick(spark, d):
    draws = table(spark, d, "supplier").select("s_suppkey", (((F.col("s_suppkey") * 7919) % 10007 + 0.5) / 10007.0).alias("u"))
    return sampling.inverse_cdf(draws, _weights(spark, d), "name", "p").select("s_suppkey", "name")


@query("SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'held out' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 2000) THEN 'broad' ELSE 'trained' END AS herd FROM part")
def holdout_split(spark, d):
    part = table(spark, d, "part")
    return sampling.herds(part, "p_brand", part.where("p_size = 1"), part.where("p_retailprice > 2000")).select("p_partkey", "herd")


_SHINGLES = r"""cut AS (SELECT kind, id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda x: x <> '') AS w FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
sh AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM cut WHERE len(w) >= 5)),
n AS (SELECT kind, id, count(*) AS n FROM sh GROUP BY ALL)"""


@query(f"WITH {_SHINGLES}, x AS (SELECT a.id AS item, b.id AS test, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.kind = 'd' AND b.kind = 'b' GROUP BY ALL) SELECT item, test, shared, round(shared / (p.n + q.n - shared), 6) AS jaccard FROM x JOIN n p ON p.kind = 'd' AND p.id = item JOIN n q ON q.kind = 'b' AND q.id = test")
def leak_join(spark, d):
    return matching.leaks(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query("SELECT c_custkey, trim(c_mktsegment) IN (SELECT trim(c_mktsegment) FROM customer WHERE c_acctbal > 9900) AS hit FROM customer")
def roster_hit_fallback(spark, d):
    people = table(spark, d, "customer")
    hits, rest = matching.roster(people, people.where("c_acctbal > 9900"), "c_mktsegment", "c_mktsegment")
    return hits.select("c_custkey", F.lit(True).alias("hit")).unionByName(rest.select("c_custkey", F.lit(False).alias("hit")))


@query("WITH t AS (SELECT string_split(p_name, ' ') AS t FROM part) SELECT DISTINCT array_to_string(t[1:i], ' ') AS prefix, coalesce(t[i + 1], '<end>') AS next FROM (SELECT t, unnest(range(0, len(t) + 1)) AS i FROM t)")
def trie_next(spark, d):
    return matching.prefixes(table(spark, d, "part").select(F.split("p_name", " ").alias("tokens")), "tokens")


def _turns(spark, d):
    talk = table(spark, d, "conversations")
    return [talk.where(F.col("role") == r).select("conv_id", F.col("turn").cast("int").alias("pos"), "text") for r in ("user", "assistant")]


@query()
def greedy_pair(spark, d):
    return matching.greedy_pairs(*_turns(spark, d), "conv_id")


def _words(c):
    return F.array_distinct(F.split(F.lower(c), " "))


def _jaccard(a, b):
    return F.size(F.array_intersect(_words(a), _words(b))) / F.size(F.array_union(_words(a), _words(b)))


@query("""WITH r AS (SELECT conv_id AS key, turn AS pos, text, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations WHERE text <> ''),
s AS (SELECT a.key, a.pos, a.text, avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))) AS trust FROM r a LEFT JOIN r b ON a.key = b.key AND a.pos <> b.pos GROUP BY ALL)
SELECT key, text, round(coalesce(trust, 1.0), 6) AS trust FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY trust DESC NULLS LAST, pos) AS k FROM s) WHERE k = 1""")
def medoid_consensus(spark, d):
    return aggregate.medoid(table(spark, d, "conversations"), "conv_id", "turn", "text", _jaccard).select("key", "text", F.round("trust", 6).alias("trust"))


@query()
def bootstrap_band(spark, d):
    return aggregate.bootstrap(table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("quality").cast("double").alias("quality")), ["lang"], "quality")


_STEP = "SELECT * REPLACE ((x * 16807 + (x >> 16)) % 2147483647 AS x)"
_HASH = f"""x1 AS (SELECT *, ((o_orderkey % 2147483647 + 1) * 48271 + d * 69621 + ((o_orderkey % 2147483647 + 1) >> 12)) % 2147483647 AS x FROM (SELECT o_orderkey::BIGINT AS o_orderkey, o_orderpriority, o_totalprice FROM orders) CROSS JOIN (SELECT unnest(range(40)) AS d)),
x2 AS ({_STEP} FROM x1), x3 AS ({_STEP} FROM x2), x4 AS ({_STEP} FROM x3)"""


@query(f"""WITH {_HASH}, t AS (SELECT o_orderpriority, d, o_totalprice AS v, {' + '.join(f'(x > {e})::INT' for e in aggregate.poisson_edges())} AS t FROM x4),
m AS (SELECT o_orderpriority, d, sum(v * t) / greatest(sum(t), 1) AS m FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m) - 1 AS r FROM m)
SELECT o_orderpriority, round((max(m) FILTER (WHERE r = 38) - max(m) FILTER (WHERE r = 0)) / 2, 4) AS band FROM r GROUP BY o_orderpriority""")
def poisson_bootstrap_band(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return aggregate.poisson_band(rows, ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderpriority", F.round("band", 4).alias("band"))


_VOCAB = " abcdefghijklmnopqrstuvwxyz"
#: Letters of the vocabulary that the documents lack.
_RARE = "ĝŭжщ가힣"


def _vocab():
    return F.create_map(*[x for k, c in enumerate(_VOCAB) for x in (F.lit(c), F.lit(k + 4))])


@query(f"SELECT item_id, list_concat([1], list_filter(list_transform(string_split(text, ''), lambda c: CASE WHEN contains('{_VOCAB}', c) THEN instr('{_VOCAB}', c)::INT + 3 END), lambda i: i IS NOT NULL), [2])::VARCHAR AS ids, len(list_filter(string_split(text, ''), lambda c: NOT contains('{_VOCAB}', c))) = 0 AS covered FROM benchmark")
def token_encode(spark, d):
    ids = T.encode(F.col("text"), _vocab())
    return table(spark, d, "benchmark").select("item_id", F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"), F.forall(T.chars(F.col("text")), lambda c: F.array_contains(F.map_keys(_vocab()), c)).alias("covered"))


@query(f"WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) SELECT v AS token FROM (SELECT unnest(string_split('{_VOCAB}0123456789@{_RARE}', '')) AS v) WHERE v NOT IN (SELECT c FROM c)")
def token_coverage(spark, d):
    seen = table(spark, d, "documents").select(F.explode(F.array_distinct(T.chars(F.col("text")))).alias("token")).distinct()
    return spark.createDataFrame([(c,) for c in _VOCAB + "0123456789@" + _RARE], "token string").join(seen, "token", "left_anti")


@query("""WITH p AS (SELECT conv_id, turn, text AS truth, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS read FROM conversations)
SELECT conv_id, turn, round(len(list_filter(range(1, least(length(read), length(truth)) + 1), lambda i: read[i] = truth[i])) / greatest(length(truth), 1), 6) AS share FROM p""")
def positional_match(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("read", F.coalesce(F.lag("text").over(w), F.lit("")))
    return rows.select("conv_id", "turn", F.round(T.positional(F.col("read"), F.col("text")), 6).alias("share"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user') WHERE k = 1")
def last_user_message(spark, d):
    return payload.last_user(table(spark, d, "conversations")).select("conv_id", "turn", "text")


@query("SELECT conv_id, n, event FROM (SELECT conv_id, turn AS n, concat('data: ', coalesce(role, ''), chr(10), chr(10)) AS event FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, concat('data: [DONE]', chr(10), chr(10)) FROM conversations GROUP BY conv_id)")
def chat_payload_rows(spark, d):
    return payload.sse(table(spark, d, "conversations"), ["conv_id"], "turn", "role")


@query("SELECT conv_id, turn, octet_length(encode(text)) AS bytes, CASE WHEN turn % 3 = 0 THEN octet_length(encode(text)) END AS decoded FROM conversations")
def data_url_decode(spark, d):
    b64 = F.base64(F.encode("text", "UTF-8"))
    url = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(b64, "\\s", ""))).when(F.col("turn") % 3 == 1, F.concat(F.lit("https://example.com/"), b64)).otherwise(F.lit("data:image/png,raw"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"), F.octet_length(payload.image_bytes(url)).cast("long").alias("decoded"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp((x::DOUBLE - list_max(embedding)::DOUBLE) / 2.0)) AS a, list_transform(embedding, lambda x: exp(-(x::DOUBLE - list_min(embedding)::DOUBLE))) AS b FROM embeddings),
p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM e)
SELECT vec_id, round(list_max(p), 6) AS top, round(4 * list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * (ln(greatest(p[i], 1e-9)) - ln(greatest(q[i], 1e-9))))), 6) AS loss FROM p""")
def softmax_kl(spark, d):
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, d, "embeddings").select("vec_id", A.softmax(x, 2.0).alias("p"), A.softmax(F.transform(x, lambda v: -v)).alias("q"))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), F.round(A.divergence(F.col("p"), F.col("q"), 2.0), 6).alias("loss"))


@query("""WITH t AS (SELECT doc_id, source, list_transform(string_split(text, ' '), lambda w: length(w)::INT) AS l FROM documents), m AS (SELECT source, max(len(l)) AS m FROM t GROUP BY source)
SELECT doc_id, len(l)::BIGINT AS n, m::BIGINT AS padded, (list_sum(l) - 100 * (m - len(l)))::BIGINT AS total, (SELECT 1 + list_sum(l) - l[len(l)])::BIGINT AS shifted FROM t JOIN m USING (source)""")
def collate_pad(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("l"))
    longest = rows.groupBy("source").agg(F.max(F.size("l")).alias("m"))
    both = rows.join(longest, "source").select("doc_id", F.size("l").cast("long").alias("n"), A.pad(F.col("l"), F.col("m")).alias("p"), A.shift_right(F.col("l"), 1, 0).alias("s"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("doc_id", "n", F.size("p").cast("long").alias("padded"), add(F.col("p")).alias("total"), add(F.col("s")).alias("shifted"))


@query("""WITH RECURSIVE v AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k, v FROM (SELECT event_type, date_trunc('day', ts) AS day, avg(value) AS v FROM events GROUP BY ALL)),
f AS (SELECT event_type, k, v::DOUBLE AS held FROM v WHERE k = 1 UNION ALL SELECT v.event_type, v.k, least(0.9, v.k / (9.0 + v.k)) * held + (1 - least(0.9, v.k / (9.0 + v.k))) * v.v FROM f JOIN v ON v.event_type = f.event_type AND v.k = f.k + 1)
SELECT event_type, round(max_by(held, k), 6) AS held FROM f GROUP BY event_type""")
def ema_fold(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.avg("value").alias("v"))
    # one value a day: a list as long as the calendar
    listed = daily.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "v"))), lambda s: s["v"]).alias("v"))
    return listed.select("event_type", F.round(A.moving_average(F.col("v"), 0.9), 6).alias("held"))


@query("SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS o_totalprice FROM orders")
def upsert_merge(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return matching.upsert(old, old.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def resume_antijoin(spark, d):
    from ..sources.files import resume

    done = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return resume(table(spark, d, "orders"), done, ["o_custkey"]).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 1")
def stale_stamps(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("stamp"))
    cache = rows.withColumn("stamp", F.when(F.col("stamp") % 2 == 1, -1).otherwise(F.col("stamp")))
    return matching.stale(rows, cache, "s_suppkey", "stamp").select("s_suppkey")


@query("WITH s AS (SELECT source, count(*) FILTER (WHERE n_chars >= 1000) AS over_goal, min(n_chars) AS worst, round(avg(n_chars), 6) AS mean FROM documents GROUP BY source) SELECT *, row_number() OVER (ORDER BY over_goal DESC, worst DESC, mean DESC, source DESC)::INT AS rank FROM s")
def rank_checkpoints(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count(F.when(F.col("n_chars") >= 1000, 1)).alias("over_goal"), F.min("n_chars").alias("worst"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(*[F.desc(c) for c in ("over_goal", "worst", "mean", "source")])))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("sha1"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp FROM events")
def iso_stamps(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("stamp"))


@query(r"SELECT lang, count(*) AS lines, count(*) FILTER (WHERE line <> '' AND NOT regexp_matches(line, '[·「」『』《》〈〉…°㎡№]')) AS drawable, count(*) FILTER (WHERE regexp_matches(line, '[\x{3131}-\x{318E}]')) AS bare FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang")
def line_filters(spark, d):
    lines = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count(F.when(T.drawable(F.col("line")), 1)).alias("drawable"), F.count(F.when(T.bare_jamo(F.col("line")), 1)).alias("bare"))


@query("SELECT o_orderkey, chr((44032 + n)::INT) AS syllable, CASE WHEN n % 28 = 0 THEN 2 ELSE 3 END AS jamo FROM (SELECT o_orderkey, o_orderkey * 7919 % 11172 AS n FROM orders)")
def hangul_compose(spark, d):
    """A syllable for each order: its parts come from the key."""
    n = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % T.S_COUNT).cast("int").alias("n"))
    whole = T.syllable(F.floor(F.col("n") / 588), F.floor((F.col("n") % 588) / 28), F.col("n") % 28)
    return n.select("o_orderkey", whole.alias("syllable"), F.length(T.nfd_hangul(whole)).alias("jamo"))


@query("""WITH t AS (SELECT l_returnflag AS side, l_linenumber AS batch, median(l_extendedprice) AS per_line FROM lineitem GROUP BY ALL), p AS (SELECT unnest(range(1, 11)) AS lines)
SELECT side, lines, batch, round(per_line * lines, 4) AS page_s FROM (SELECT *, row_number() OVER (PARTITION BY side, lines ORDER BY abs(batch - lines), batch DESC) AS k FROM t CROSS JOIN p) WHERE k = 1""")
def page_cost(spark, d):
    timed = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("batch")).agg(F.percentile("l_extendedprice", 0.5).alias("per_line"))
    # measured batches are a short list for each side
    rows = timed.withColumn("lines", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    near = matching.first_of(rows, ["side", "lines"], [F.abs(F.col("batch") - F.col("lines")), F.desc("batch")])
    return near.select("side", "lines", "batch", F.round(F.col("per_line") * F.col("lines"), 4).alias("page_s"))


@query("""WITH b AS (SELECT (event_id // 12)::BIGINT AS page, event_id % 12 AS k, (floor(abs(value))::BIGINT % 200 + 60) AS wide FROM events)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY k) - 1)::INT AS pos, 0 AS left, (k * 32 + 20)::INT AS top, wide::INT AS right, (k * 32 + 32)::INT AS bottom FROM b""")
def page_segments(spark, d):
    """Lines of pages drawn from events: a bar for each, at a place and width given by its value. The cut must find the
    rectangles again."""
    import numpy as np

    bars = table(spark, d, "events").select(F.floor(F.col("event_id") / 12).alias("page"), F.struct((F.col("event_id") % 12).cast("int").alias("k"), (F.floor(F.abs("value")).cast("long") % 200 + 60).cast("int").alias("wide")).alias("bar"))
    pages = bars.groupBy("page").agg(F.collect_list("bar").alias("bars"))

    def draw(bars):
        page = np.full((400, 320), 255, np.uint8)
        for bar in bars:
            page[bar["k"] * 32 + 20 : bar["k"] * 32 + 32, : bar["wide"]] = 0
        return page

    return segment.drawn_lines(pages, "bars", draw)


@query()
def ensemble_trust(spark, d):
    """Three stand-in readers of each conversation turn, and the vote."""
    cells = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("cell"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("pix"))
    readers = {"plain": lambda x: [b.decode() for b in x], "lower": lambda x: [b.decode().lower() for b in x], "cut": lambda x: [b.decode().rstrip(".") for b in x]}
    return reading.trusted(reading.read(cells, readers), _jaccard)


# registers its queries in the tables above
from . import lines as _lines, photos as _photos, rules as _rules, scores as _scores, shapes as _shapes, states as _states, stores as _stores  # noqa: E402, F401

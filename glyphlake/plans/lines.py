"""Registered queries of generated lines and of Hangul text, with SQL for the same rows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import grammar
from ..operators.aggregate import PRIME
from ..session import dealt, table
from .catalog import query
from .rules import _hashes

#: Where each pool of words comes from: a table and an expression of its words.
POOLS = {
    "surname": ("nation", "n_name"), "given": ("region", "r_name"), "org_head": ("part", "p_name"), "org_tail": ("customer", "c_mktsegment"), "doc_head": ("part", "p_type"), "doc_tail": ("part", "p_brand"),
    "label": ("orders", "o_orderpriority"), "org_label": ("customer", "c_mktsegment"), "name_label": ("region", "r_name"), "date_label": ("events", "event_type"), "nothing": ("orders", "o_orderstatus"),
    "subject": ("nation", "n_name"), "verb": ("events", "event_type"), "object": ("part", "p_name"), "adverb": ("region", "r_name"), "latin_short": ("lineitem", "l_linestatus"), "latin_word": ("documents", "source"),
}


def _pools(spark, d):
    """A column is read once, whichever pools take its words."""
    out = None
    for name, column in dict.fromkeys(POOLS.values()):
        words = table(spark, d, name).select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''").distinct()
        pools = [F.lit(p) for p, of in POOLS.items() if of == (name, column)]
        rows = words.select(F.explode(F.array(*pools)).alias("pool"), "word", F.lit(1).cast("long").alias("weight"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _items(items) -> str:
    return "[" + ", ".join(f"{{'kind': {_quoted(k)}, 'name': {_quoted(n)}, 'a': {a}, 'b': {b}, 'c': {c}}}" for k, n, a, b, c in items) + "]"


def _drawn(at: int, weights) -> str:
    entries = grammar.alias(weights)
    return f"(CASE WHEN h[{at + 1}] % {sum(weights)} < {[t for t, _ in entries]}[h[{at}] % {len(weights)} + 1] THEN h[{at}] % {len(weights)} ELSE {[o for _, o in entries]}[h[{at}] % {len(weights)} + 1] END)"


def _syllable(at: int) -> str:
    return f"chr((44032 + ({_drawn(at, grammar.HEAD)} * 21 + {_drawn(at + 2, grammar.MID)}) * 28 + {_drawn(at + 4, grammar.TAIL)})::INT)"


def _line_sql() -> str:
    rules = grammar.lines()
    deep = grammar.depth(rules, "decorated")
    values = ",\n".join(f"({_quoted(s)}, {k}, {n}, {t}, {b}, {_items(i)}, {_items(o)})" for s, k, n, t, b, i, o in grammar.alternatives(rules))
    pools = " UNION ALL ".join(f"SELECT DISTINCT '{p}' AS pool, unnest(string_split({c}, ' ')) AS word FROM {t}" for p, (t, c) in POOLS.items())
    made = f"concat({_syllable(5)}, {_syllable(11)}, CASE WHEN h[4] % 2 = 1 THEN {_syllable(17)} ELSE '' END)"
    slot = f"(CASE WHEN h[3] % 1000 < {grammar.REPLACED} THEN concat({made}, right(word, a)) ELSE word END)"
    step = f"(code * 48271 + (j + 1) * 69621 + (code >> 12)) % {PRIME}"
    return rf"""WITH RECURSIVE r(symbol, slot, n, total, below, items, others) AS (VALUES
{values}),
x AS (SELECT c_custkey::BIGINT AS pos, {{'kind': '', 'name': 'decorated', 'a': 0, 'b': 0, 'c': 0}} AS item, c_custkey::BIGINT % {PRIME} AS code, '' AS path, '' AS shape, 0 AS level FROM customer
UNION ALL SELECT pos, items[j + 1] AS item, CASE WHEN plain THEN code ELSE {step} END AS code, concat(path, lpad(j::VARCHAR, 2, '0')) AS path, CASE WHEN level = 0 THEN coalesce(nullif(items[j + 1].name, ''), items[j + 1].kind) ELSE shape END AS shape, level + 1 AS level
 FROM (SELECT *, unnest(range(len(items))) AS j FROM (SELECT pos, code, path, shape, level, r.symbol IS NULL AS plain, CASE WHEN r.symbol IS NULL THEN [item] WHEN h[2] % r.total < r.below THEN r.items ELSE r.others END AS items
  FROM (SELECT *, {_hashes(2, 'code')} AS h FROM x WHERE level < {deep}) y LEFT JOIN (SELECT symbol AS s, any_value(n) AS n FROM r GROUP BY symbol) z ON y.item.kind = '' AND y.item.name = z.s LEFT JOIN r ON r.symbol = z.s AND r.slot = y.h[1] % z.n))),
p AS (SELECT pool, word, row_number() OVER (PARTITION BY pool ORDER BY word) - 1 AS slot, count(*) OVER (PARTITION BY pool) AS n FROM ({pools}) WHERE word <> ''),
t AS (SELECT pos, path, shape, item.kind AS kind, item.name AS name, item.a AS a, item.b AS b, item.c AS c, {_hashes(grammar.DRAWS, 'code')} AS h FROM x WHERE level = {deep}),
w AS (SELECT t.*, p.word FROM t LEFT JOIN (SELECT pool, any_value(n) AS n FROM p GROUP BY pool) q ON t.kind IN ('@', '?') AND q.pool = t.name LEFT JOIN p ON p.pool = q.pool AND p.slot = t.h[1] % q.n),
e AS (SELECT pos, shape, path, CASE kind WHEN '=' THEN name WHEN '@' THEN word WHEN '#' THEN lpad((a + h[1] % (b - a + 1))::VARCHAR, greatest(c, length((a + h[1] % (b - a + 1))::VARCHAR))::INT, '0') WHEN '^' THEN {_syllable(1)} WHEN '&' THEN chr((12593 + h[1] % 51)::INT) ELSE left({slot}, length({slot}) - b) END AS text FROM w),
l AS (SELECT pos, max(shape) AS shape, string_agg(text, '' ORDER BY path) AS text FROM e GROUP BY pos)
SELECT pos, shape, CASE WHEN text[1] <> chr(1) THEN text WHEN contains(text[3:], ' ') THEN concat(split_part(text[3:], ' ', 1), ' ', text[2], ' ', substr(text[3:], instr(text[3:], ' ') + 1)) ELSE text[3:] END AS text FROM l"""


@query(_line_sql())
def generated_lines(spark, d):
    """A line of the grammar for each customer, with words of the given tables."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("pos"))
    return grammar.expand(rows, grammar.lines(), _pools(spark, d), "decorated")


@query("""WITH w AS (SELECT lang AS pool, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents), c AS (SELECT pool, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
SELECT pool, word, round(n / sum(n) OVER (PARTITION BY pool), 9) AS share FROM c""")
def alias_shares(spark, d):
    """How often an alias table gives each word of a language's documents: as often as it stands there."""
    words = table(spark, d, "documents").select(F.col("lang").alias("pool"), F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word")).where("word <> ''")
    slots = grammar.alias_words(words.groupBy("pool", "word").agg(F.count("*").alias("weight")))
    own = slots.select("pool", "word", "n", "total", F.col("below").alias("share"))
    lent = slots.select("pool", F.col("other").alias("word"), "n", "total", (F.col("total") - F.col("below")).alias("share"))
    got = own.unionByName(lent).groupBy("pool", "word").agg(F.sum("share").alias("s"), F.first("n").alias("n"), F.first("total").alias("total"))
    return got.select("pool", "word", F.round(F.col("s") / F.col("n") / F.col("total"), 9).alias("share"))


#: Letters turned to syllables without, with one and with a double tail, and to a jamo that stands alone.
_LETTERS = {"a": "가", "e": "한", "i": "글", "o": "닭", "u": "외", "t": "ㅋ", "s": "힣"}


def _taken(text: str) -> str:
    for letter, syllable in _LETTERS.items():
        taken = unicodedata.normalize("NFD", syllable)
        text = f"replace({text}, '{letter}', '{taken}')"
    return text


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(lower(text), '[^\x00-\x7F]', '?', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace({_taken('t')}, '\s+', '', 'g')) AS tight, contains(t, 't') AS bare, (SELECT count(*) FROM (SELECT unnest(string_split(t, chr(10))) AS l) WHERE l <> '' AND NOT contains(l, 't')) AS kept FROM t""")
def hangul_rules(spark, d):
    """Documents whose letters are turned to Hangul: taken apart and tightened, whether a jamo stands alone, lines without any."""
    text = F.translate(T.ascii_fold(F.lower("text")), "".join(_LETTERS), "".join(_LETTERS.values()))
    # a small file is one task's
    rows = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.explode(F.array(text)).alias("t"))
    kept = F.size(F.filter(F.split("t", "\n"), lambda x: (x != "") & ~T.bare_jamo(x))).cast("long")
    return rows.select("doc_id", F.md5(F.encode(T.tight(T.nfd_hangul(F.col("t"))), "UTF-8")).alias("tight"), T.bare_jamo(F.col("t")).alias("bare"), kept.alias("kept"))

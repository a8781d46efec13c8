"""Lines from a weighted grammar held as tables: rules expanded level by level, alternatives and words drawn by alias tables.

A grammar is a list of rules (symbol, weight, items). An item is a symbol, or a terminal: `=text`; `@pool`, a word of a pool;
`#lo-hi-width`, a number; `^`, a Hangul syllable by the weights of its parts; `&`, a single jamo; `?pool-keep-cut`, a slot: a
word of the pool that three times in ten is replaced by two or three made syllables before its last `keep` letters, and then
loses `cut` letters. Words come as a table (pool, word, weight).

An alias table answers a draw from n weighted entries with one look: slot i keeps its own entry below a threshold and gives
another from there on. Weights are integers and so are thresholds, so shares are exact. Every draw hashes the row's key and the
place in the expansion, with integer arithmetic that any engine can repeat; partitions play no part.

A row's symbols are expanded by a broadcast join a level (rules are a checked number), its parts are put together in order by
one shuffle on the row's key. Rules must not lead back to themselves. A pool without words, a symbol without rules raise.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import dealt, stored
from .aggregate import PRIME

Rule = tuple[str, int, Sequence[str]]
#: Most alternatives of a grammar (they are broadcast), and most words of a pool (its alias table is built in one task).
RULES, WORDS = 20_000, 2_000_000
#: Hashes of a terminal, and how often (of 1000) a slot is replaced.
DRAWS, REPLACED = 24, 300

#: How often the parts of a syllable occur, times 100: 19 heads, 21 vowels, no tail and 27 tails.
HEAD = (900, 100, 700, 600, 100, 700, 600, 500, 100, 900, 200, 1200, 800, 100, 300, 200, 200, 200, 500)
MID = (1700, 500, 200, 100, 900, 500, 400, 100, 800, 100, 50, 100, 200, 600, 50, 50, 50, 100, 900, 100, 1500)
TAIL = (5700, 900, 100, 16, 1200, 16, 16, 100, 900, 16, 16, 16, 16, 16, 16, 16, 500, 200, 16, 400, 100, 1400, 100, 100, 50, 100, 50, 100)
#: Marks around a line, after it, between symbols, between words.
WRAPPERS = (("(", ")"), ("(", ")"), ("(", ")"), ("[", "]"), ("<", ">"), ("{", "}"), ("'", "'"), ('"', '"'))
TRAILERS = (".", ",", "!", "?", ";", ":", "~")
JOINERS = ("/", "-", "_", "+", "=", "&", "*", "#", "@", "%", "^", "|", "\\", "`")
BETWEEN = ("/", "-", "+", "&", "~")


def alias(weights: Sequence[int]) -> list[tuple[int, int]]:
    """(threshold of the total, other entry) for each entry: a draw of slot i and of r below the total takes i if r is below
    the threshold, else the other."""
    n, total = len(weights), sum(weights)
    left = [w * n for w in weights]
    low, high = [i for i in range(n) if left[i] < total], [i for i in range(n) if left[i] >= total]
    out = [(total, i) for i in range(n)]
    while low and high:
        i, j = low.pop(), high[-1]
        out[i] = (left[i], j)
        left[j] -= total - left[i]
        if left[j] < total:
            low.append(high.pop())
    return out


def alias_words(words: DataFrame) -> DataFrame:
    """words(pool, word, weight long) -> pool, slot, n, total, word, below, other. A word that is there twice counts twice."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        if len(p) > WORDS:
            raise ValueError(f"a pool of more than {WORDS} words")
        p = p.sort_values("word", kind="stable").reset_index(drop=True)
        table = alias(p["weight"].tolist())
        return pd.DataFrame({"pool": p["pool"], "slot": range(len(p)), "n": len(p), "total": int(p["weight"].sum()), "word": p["word"], "below": [t for t, _ in table], "other": p["word"].take([o for _, o in table]).tolist()})

    summed = words.where("word IS NOT NULL AND weight > 0").groupBy("pool", "word").agg(F.sum("weight").cast("long").alias("weight"))
    return summed.groupBy("pool").applyInPandas(each, "pool string, slot long, n long, total long, word string, below long, other string")


def parsed(item: str, symbols: set[str]) -> tuple:
    """(kind, name, a, b, c) of an item."""
    kind, rest = item[0], item[1:]
    if item in symbols:
        return ("", item, 0, 0, 0)
    if kind in "=@":
        return (kind, rest, 0, 0, 0)
    if kind == "#":
        return (kind, "", *map(int, rest.split("-")))
    if kind == "?":
        pool, keep, cut = rest.split("-")
        return (kind, pool, int(keep), int(cut), 0)
    if item in ("^", "&"):
        return (kind, "", 0, 0, 0)
    raise ValueError(f"no rule for {item!r}")


def depth(rules: Sequence[Rule], start: str) -> int:
    """Levels until only terminals are left; raises where a symbol leads back to itself."""
    follow: dict[str, set[str]] = {}
    for symbol, _, items in rules:
        follow.setdefault(symbol, set()).update(items)

    def deep(symbol, above):
        if symbol in above:
            raise ValueError(f"{symbol} leads back to itself")
        return 1 + max((deep(s, above | {symbol}) for s in follow[symbol] if s in follow), default=0)

    return deep(start, frozenset())


def alternatives(rules: Sequence[Rule]) -> list[tuple]:
    """(symbol, slot, n, total, below, items, other items): the rules' alias tables."""
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    by: dict[str, list] = {}
    for symbol, weight, items in rules:
        by.setdefault(symbol, []).append((weight, items))
    out = []
    for symbol, all_ in by.items():
        for slot, (below, other) in enumerate(alias([w for w, _ in all_])):
            out.append((symbol, slot, len(all_), sum(w for w, _ in all_), below, [parsed(i, set(by)) for i in all_[slot][1]], [parsed(i, set(by)) for i in all_[other][1]]))
    return out


def _drawn(df: DataFrame, first: int, last: int, where: Column | None = None) -> DataFrame:
    """df with columns h<first> .. h<last>, those of hashes(code, last), for rows with `where` (others: null). A step is a
    projection of its own: each value is computed once, and by compiled code, as no array is walked through."""
    names = [f"h{k}" for k in range(first, last + 1)]
    start = F.pmod(F.col("code"), F.lit(PRIME)) + 1
    df = df.withColumn("start", start if where is None else F.when(where, start))
    df = df.withColumns({h: (F.col("start") * 48271 + (int(h[1:]) - 1) * 69621 + F.shiftright("start", 12)) % PRIME for h in names}).drop("start")
    for _ in range(3):
        df = df.withColumns({h: (F.col(h) * 16807 + F.shiftright(h, 16)) % PRIME for h in names})
    return df


def _weighted(at: int, weights: Sequence[int]) -> Column:
    """Index drawn by the columns h<at> and h<at + 1> from an alias table written into the plan."""
    table, total = alias(weights), sum(weights)
    slot = F.col(f"h{at}") % len(weights)
    below, other = (F.element_at(F.array(*[F.lit(t[k]) for t in table]), (slot + 1).cast("int")) for k in (0, 1))
    return F.when(F.col(f"h{at + 1}") % total < below, slot).otherwise(other)


def syllable(at: int) -> Column:
    """A syllable from the columns h<at> .. h<at + 5>."""
    return T.syllable(*(_weighted(at + 2 * k, w) for k, w in enumerate((HEAD, MID, TAIL))))


def _numbered(rules: Sequence[Rule], start: str) -> tuple[pa.Table, tuple[int, int]]:
    """Alternatives by number, and the start's first number and how many it has. An item holds those of its symbol, so a
    draw finds its alternative by one number; terminals have none."""
    rows = alternatives(rules)
    begin: dict[str, int] = {}
    for i, r in enumerate(rows):
        begin.setdefault(r[0], i)
    held = lambda items: [{"at": begin[n] if k == "" else None, "n": rows[begin[n]][2] if k == "" else None, "kind": k, "name": n, "a": a, "b": b, "c": c} for k, n, a, b, c in items]
    item = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32())]))
    cols = {"number": pa.array(range(len(rows)), pa.int64()), "total": pa.array([r[3] for r in rows], pa.int64()), "below": pa.array([r[4] for r in rows], pa.int64()), "items": pa.array([held(r[5]) for r in rows], item), "others": pa.array([held(r[6]) for r in rows], item)}
    return pa.table(cols), (begin[start], rows[begin[start]][2])


def expand(rows: DataFrame, rules: Sequence[Rule], words: DataFrame, start: str, key: str = "pos") -> DataFrame:
    """rows(key integer) -> key, shape (the start's first item, or its kind), text: a line for each key."""
    spark = rows.sparkSession
    numbered, (at, n) = _numbered(rules, start)
    table = F.broadcast(spark.createDataFrame(numbered))
    first = F.struct(F.lit(at).cast("long").alias("at"), F.lit(n).cast("long").alias("n"), F.lit("").alias("kind"), F.lit(start).alias("name"), *[F.lit(0).alias(c) for c in "abc"])
    code = F.pmod(F.col(key).cast("long"), F.lit(PRIME))
    # keys are a few bytes a row, lines cost much: a file of keys is not one task's
    now = dealt(rows.select(key), key).select(key, first.alias("item"), code.alias("code"), F.lit("").alias("path"), F.lit("").alias("shape"))
    for level in range(depth(rules, start)):
        drawn = _drawn(now, 1, 2).join(table, F.col("item.at") + F.col("h1") % F.col("item.n") == F.col("number"), "left")
        items = F.when(F.col("number").isNull(), F.array("item")).when(F.col("h2") % F.col("total") < F.col("below"), F.col("items")).otherwise(F.col("others"))
        parts = drawn.select(key, "code", "path", "shape", F.col("number").isNull().alias("plain"), F.posexplode(items).alias("i", "item"))
        below = F.when(F.col("plain"), F.col("code")).otherwise((F.col("code") * 48271 + (F.col("i") + 1) * 69621 + F.shiftright("code", 12)) % PRIME)
        shape = F.when(F.lit(level == 0), F.coalesce(F.nullif(F.col("item.name"), F.lit("")), F.col("item.kind"))).otherwise(F.col("shape"))
        now = parts.select(key, "item", below.alias("code"), F.concat("path", F.lpad(F.col("i").cast("string"), 2, "0")).alias("path"), shape.alias("shape"))
    # the plan of the levels ends here
    now = stored(now.select(key, "path", "shape", "code", *[F.col(f"item.{c}").alias(c) for c in ("kind", "name", "a", "b", "c")]), "parts")
    now = _drawn(now, 1, 4)
    # read twice, and by each terminal
    pools = stored(alias_words(words), "pools")
    sizes = F.broadcast(pools.groupBy("pool").agg(F.first("n").alias("n"), F.first("total").alias("total")))
    worded = now.join(sizes, F.col("kind").isin("@", "?") & (F.col("name") == F.col("pool")), "left").drop("pool")
    worded = worded.withColumn("at", F.col("h1") % F.col("n")).join(pools.select("pool", "slot", F.col("word"), "below", "other"), (F.col("name") == F.col("pool")) & (F.col("at") == F.col("slot")), "left")
    word = F.when(F.col("h2") % F.col("total") < F.col("below"), F.col("word")).otherwise(F.col("other"))
    word = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no words in pool "), "name"))).otherwise(word)
    kind, replaced = F.col("kind"), (F.col("kind") == "?") & (F.col("h3") % 1000 < REPLACED)
    worded = worded.select(key, "shape", "path", "code", "kind", "name", "a", "b", "c", "h1", "h2", "h3", "h4", F.when(kind.isin("@", "?"), word).alias("word"))
    worded = _drawn(worded, 5, DRAWS - 2, (kind == "^") | replaced)
    # a projection each, so that each is a method of its own
    for name, of, when in (("own", 1, kind == "^"), ("m1", 5, replaced), ("m2", 11, replaced), ("m3", 17, replaced & (F.col("h4") % 2 == 1))):
        worded = worded.withColumn(name, F.when(when, syllable(of)))
    # a right of 0 letters is empty
    slotted = F.when(replaced, F.concat("m1", "m2", F.coalesce("m3", F.lit("")), F.right("word", F.col("a")))).otherwise(F.col("word"))
    worded = worded.withColumn("slotted", F.when(kind == "?", slotted))
    number = (F.col("a") + F.col("h1") % (F.col("b") - F.col("a") + 1)).cast("string")
    jamo = T.char((F.lit(0x3131) + F.col("h1") % 51).cast("int"))
    text = F.when(kind == "=", F.col("name")).when(kind == "@", F.col("word")).when(kind == "#", F.lpad(number, F.greatest(F.col("c"), F.length(number)), "0")).when(kind == "^", F.col("own")).when(kind == "&", jamo).otherwise(F.left("slotted", F.length("slotted") - F.col("b")))
    parts = worded.select(key, "shape", "path", text.alias("text"))
    # parts of one line
    whole = parts.groupBy(key).agg(F.max("shape").alias("shape"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.select(key, "shape", between(F.col("text")).alias("text"))


def between(text: Column) -> Column:
    """A text led by \\x01 and a mark gets that mark between its first two words, if there are two."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^\x01(.)([^ ]*) (.*)$", "$2 $1 $3"), r"(?s)^\x01.", "")


def repeated(symbol: str, item: str | Sequence[str], least: int, most: int, between: str = "") -> list[Rule]:
    """Rules of `symbol` for least to most times an item, equally often."""
    items = [item] if isinstance(item, str) else list(item)
    gap = [f"={between}"] if between else []
    return [(symbol, 1, [x for k in range(n) for x in (gap if k else []) + items]) for n in range(least, most + 1)]


def lines() -> list[Rule]:
    """The grammar of generated lines, from `decorated` on. Its weights are fixed values (of 1000 where not said otherwise)."""
    rules: list[Rule] = [
        ("decorated", 40, ["wrapped"]), ("decorated", 60, ["line", "trailer"]), ("decorated", 20, ["bullet", "= ", "line"]), ("decorated", 40, ["=\x01", "between", "line"]), ("decorated", 8, ["#1-20-0", "after", "= ", "line"]), ("decorated", 832, ["line"]),
        ("line", 340, ["random"]), ("line", 340, ["form"]), ("line", 210, ["title"]), ("line", 80, ["sentence"]), ("line", 30, ["long"]),
        ("random", 550, ["syllables"]), ("random", 150, ["mixed"]), ("random", 120, ["jamos"]), ("random", 40, ["latins"]), ("random", 70, ["symbols"]), ("random", 70, ["number"]),
        ("part", 500, ["few"]), ("part", 300, ["latin"]), ("part", 200, ["digits"]),
        ("bit", 450, ["joiner"]), ("bit", 550, ["few"]),
        ("form", 220, ["doc"]), ("form", 180, ["@org_label", "gap", "org"]), ("form", 200, ["@name_label", "gap", "name"]), ("form", 100, ["@date_label", "gap", "date"]), ("form", 80, ["org"]), ("form", 80, ["name"]), ("form", 40, ["date"]), ("form", 50, ["@label"]), ("form", 50, ["@label", "= : ", "@nothing"]),
        ("gap", 56, ["= : "]), ("gap", 10, ["=: "]), ("gap", 20, ["= "]), ("gap", 10, ["=  "]), ("gap", 4, ["= - "]),
        ("title", 260, ["@doc_tail"]), ("title", 260, ["@doc_head", "@doc_tail"]), ("title", 160, ["org"]), ("title", 100, ["latin_title", "latin_gap", "latin_tail"]), ("title", 170, ["made_title"]), ("title", 50, ["@doc_head", "unit", "@doc_tail"]),
        ("latin_title", 720, ["@latin_word"]), ("latin_title", 280, ["@latin_short"]), ("latin_gap", 750, ["= "]), ("latin_gap", 250, ["="]), ("latin_tail", 700, ["@doc_tail"]), ("latin_tail", 300, ["@org_tail"]),
        ("made_title", 550, ["made", "any_tail"]), ("made_title", 450, ["made"]), ("any_tail", 1, ["@org_tail"]), ("any_tail", 1, ["@doc_tail"]),
        ("name", 960, ["@surname", "given"]), ("name", 40, ["@surname", "@surname", "given"]), ("given", 3, ["@given", "@given"]), ("given", 1, ["@given", "@given", "@given"]),
        ("org", 100, ["@latin_short", "heads", "@org_tail"]), ("org", 80, ["@latin_short", "@org_tail"]), ("org", 30, ["@latin_short", "= ", "@org_tail"]), ("org", 790, ["heads", "@org_tail"]),
        ("heads", 750, ["org_head"]), ("heads", 250, ["org_head", "@org_head"]), ("org_head", 150, ["made"]), ("org_head", 850, ["@org_head"]),
        ("doc", 700, ["doc_head", "maybe", "@doc_tail"]), ("doc", 300, ["doc_head", "= ", "@doc_head", "maybe", "@doc_tail"]), ("doc_head", 180, ["made"]), ("doc_head", 820, ["@doc_head"]), ("maybe", 1, ["="]), ("maybe", 1, ["= "]),
        ("date", 400, ["#2019-2030-0", "=-", "#1-12-2", "=-", "#1-28-2"]), ("date", 300, ["#2019-2030-0", "=.", "#1-12-2", "=.", "#1-28-2"]), ("date", 300, ["#2019-2030-0", "=년 ", "#1-12-0", "=월 ", "#1-28-0", "=일"]),
        ("latin", 300, ["@latin_short"]), ("latin", 220, ["@latin_word"]), ("latin", 200, ["latin_made"]), ("latin", 160, ["capitals"]), ("latin", 80, ["latin_either", "latin_mark", "#1-99-0"]), ("latin", 40, ["latin_small"]),
        ("latin_either", 1, ["@latin_word"]), ("latin_either", 1, ["latin_made"]), ("latin_mark", 1, ["= "]), ("latin_mark", 1, ["=-"]), ("latin_mark", 1, ["="]),
        ("latin_made", 275, ["Consonant", "vowel", "pair", "ending"]), ("latin_made", 225, ["Consonant", "vowel", "pair"]), ("latin_made", 275, ["Consonant", "vowel", "pair", "pair", "ending"]), ("latin_made", 225, ["Consonant", "vowel", "pair", "pair"]),
        ("latin_small", 275, ["pair", "pair", "ending"]), ("latin_small", 225, ["pair", "pair"]), ("latin_small", 275, ["pair", "pair", "pair", "ending"]), ("latin_small", 225, ["pair", "pair", "pair"]), ("pair", 1, ["consonant", "vowel"]),
        ("sentence", 450, ["?subject-0-0", "is", "= ", "?object-1-0", "= ", "?verb-2-0"]), ("sentence", 300, ["?adverb-0-0", "= ", "?subject-0-0", "topic", "= ", "?object-1-0", "= ", "?verb-2-0"]), ("sentence", 250, ["?subject-0-0", "=와 ", "?subject-0-0", "=, ", "?subject-0-0", "=를 ", "?adverb-0-0", "= ", "?verb-2-0"]),
        ("long", 1, ["?subject-0-0", "object_mark", "= ", "?verb-2-2", "=면 ", "?subject-0-0", "= ", "?object-1-0", "= ", "subjects", "with", "= ", "?adverb-0-0", "= ", "?verb-2-0", "=."]),
    ]
    for symbol, marks in (("trailer", TRAILERS), ("bullet", "-*"), ("between", BETWEEN), ("after", ".)-"), ("joiner", JOINERS), ("unit", ("TF", "팀", "부", "실")), ("is", "는은이가"), ("topic", "는은"), ("object_mark", "를을"), ("with", "와과"), ("consonant", "bcdfghjklmnpqrstvwxyz"), ("Consonant", "BCDFGHJKLMNPQRSTVWXYZ"), ("vowel", "aeiou"), ("ending", "nrstxlm"), ("capital", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789")):
        rules += [(symbol, 1, [f"={m}"]) for m in marks]
    rules += [("wrapped", 1, [f"={a}", "line", f"={b}"]) for a, b in WRAPPERS]
    for gap, weight in (("", 6), (" ", 4)):
        rules += [("mixed", weight * w, items) for _, w, items in repeated("mixed", "part", 2, 5, gap)]
    for gap in ("", " "):
        rules += repeated("symbols", "bit", 2, 5, gap)
    rules += repeated("syllables", "^", 1, 9) + repeated("few", "^", 1, 3) + repeated("made", "^", 2, 4) + repeated("jamo", "&", 1, 3) + repeated("jamos", "jamo", 2, 5, " ")
    rules += repeated("latins", "latin", 1, 2, " ") + repeated("number", "digit", 2, 10) + repeated("digits", "digit", 1, 4) + repeated("capitals", "capital", 2, 4) + repeated("subjects", "?subject-0-0", 2, 4, ", ")
    return rules


def digit_lines() -> list[Rule]:
    """Rows of digits that are cut like a date and are none, from `digit_line` on; weights are fixed values."""
    rules: list[Rule] = [("digit", 1, [f"={d}"]) for d in range(10)]
    rules += repeated("group", "digit", 1, 5)
    for gap in ("-", ".", "/", " ", "", "-"):
        for n, weight in ((1, 35), (2, 30), (3, 25), (4, 10)):
            rules.append(("digit_line", weight, [x for k in range(n) for x in ([f"={gap}"] if k and gap else []) + ["group"]]))
    return rules

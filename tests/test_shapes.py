"""Bitmap twins, glyph index, prefix walk, numbering and the grammar against plain versions and on edges."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.operators import glyphs, grammar, numbering, twins, walking


def test_twins_against_all_pairs(spark):
    r = random.Random(2)
    base = [[r.random() < 0.4 for _ in range(150)] for _ in range(6)]
    items = []
    for i in range(80):
        flags = list(r.choice(base))
        for _ in range(r.choice((0, 3, 10, 40))):
            flags[r.randrange(150)] ^= True
        items.append((i, flags))
    items += [(90, [False] * 150), (91, []), (92, None), (93, base[0]), (94, base[0])]
    tests = [(100 + k, k, f) for k, f in enumerate(base)] + [(99, 0, base[1]), (110, 9, [False] * 150)]
    pack = lambda rows, kind: spark.createDataFrame(rows, kind).withColumn("bits", twins.packed(F.col("f")))
    got = {x["id"]: (x["twin"], round(x["iou"], 9)) for x in twins.twins(pack(items, "id long, f array<boolean>"), pack(tests, "id long, place int, f array<boolean>")).collect()}
    want = {}
    for i, f in items:
        best = None
        for t, place, g in sorted(tests, key=lambda x: (x[1], x[0])):
            both, either = sum(a and b for a, b in zip(f or [], g)), sum(a or b for a, b in itertools.zip_longest(f or [], g, fillvalue=False))
            if either and both / either >= 0.7 and (best is None or both / either > best[1]):
                best = (t, both / either)
        if best:
            want[i] = (best[0], round(best[1], 9))
    assert got == want and len(want) > 30


@pytest.mark.parametrize("wide", [1, 3])
def test_twins_of_packs_against_all_pairs(wide):
    r = np.random.default_rng(wide)
    a, b = (r.integers(1, 1 << 63, (n, wide)).astype(np.uint64) & r.integers(1, 1 << 63, (n, wide)).astype(np.uint64) | np.uint64(1) for n in (300, 500))
    b[400:] = b[:100]
    both, ones, n = np.bitwise_count(a[:, None] & b[None]).sum(2, dtype=int), np.bitwise_count(a).sum(1, dtype=int), np.bitwise_count(b).sum(1, dtype=int)
    iou = both / (ones[:, None] + n - both)
    got = {}
    for i, j, shared, united in twins.nearest(a, b, 0.4):
        assert shared == both[i, j] and shared / united == iou[i].max()
        got[i] = min(j, got.get(i, j))
    assert got == {i: iou[i].argmax() for i in range(300) if iou[i].max() >= 0.4} and got


def test_twins_many_pictures_with_copies(spark):
    # copies are compared once, pairs aren't rows of a join: 20,000 pictures and 20,000 test pictures are 4 * 10^8 pairs
    r = np.random.default_rng(4)
    base = r.integers(1, 1 << 62, 20_000).tolist()
    items = spark.createDataFrame([(i, [base[i % 10_000]]) for i in range(20_000)], "id long, bits array<long>")
    tests = spark.createDataFrame([(-1 - k, 20_000 - k, [x]) for k, x in enumerate(base)] + [(7, 30_000, [base[0]])], "id long, place long, bits array<long>")
    made = twins.twins(items, tests)
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert {x["id"]: x["twin"] for x in got} == {i: -1 - i % 10_000 for i in range(20_000)} and all(x["iou"] == 1 for x in got)


def test_glyph_index_over_many_fonts(spark):
    r = random.Random(3)
    fonts = {f"f{i:03d}": set(r.sample("abcdefgh", r.randrange(0, 8))) for i in range(150)}
    covers = spark.createDataFrame([(f, g) for f, gs in fonts.items() for g in (gs or [None])], "font string, glyph string")
    texts = [" ", "", None, "a b", "abc", "z", "ah\tz", "hgfe a"]
    got = {x["k"]: (x["letters"], x["fonts"], x["drawable"]) for x in glyphs.drawing(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), covers, ["k"]).collect()}
    for k, t in enumerate(texts):
        letters = {c for c in t or "" if not c.isspace()}
        n = sum(letters <= gs for gs in fonts.values())
        assert got[k] == (len(letters), n, n > 0)


def plain_walk(scores, options, beam):
    tree = collections.defaultdict(set)
    for o in options:
        for i in range(len(o) + 1):
            tree[tuple(o[:i])].add(o[i] if i < len(o) else walking.END)
    front = [((), 0, False)]
    for step in range(max(map(len, options)) + 1):
        moved = [f for f in front if f[2]]
        for path, total, done in front:
            for token in tree[path] if not done else ():
                if (step, token) in scores:
                    moved.append((path if token == walking.END else (*path, token), total + scores[step, token], token == walking.END))
        front = sorted(moved, key=lambda f: (-f[1], walking.JOIN.join(f[0])))[:beam]
    top = [f for f in front if f[2]]
    return (" ".join(top[0][0]), top[0][1]) if top else ("", None)


@pytest.mark.parametrize("beam", [1, 3, 50])
def test_walk_against_a_plain_search(spark, beam):
    r = random.Random(beam)
    words = ["ka", "la", "ma", "na"]
    options = [[r.choice(words) for _ in range(r.randrange(1, 5))] for _ in range(25)]
    cells = {c: {(s, t): r.randrange(-9, 9) for s in range(6) for t in [*words, walking.END] if r.random() < 0.8} for c in range(30)}
    cells[99] = {(0, "off"): 5}
    rows = [(c, s, t, v) for c, x in cells.items() for (s, t), v in x.items()] + [(0, 0, "ka", None)]
    opts = spark.createDataFrame([(o,) for o in options] + [([],), (None,)], "tokens array<string>")
    got = {x["cell"]: (x["text"], x["total"]) for x in walking.walk(spark.createDataFrame(rows, "cell int, step int, token string, score int"), opts, beam).collect()}
    assert got == {c: plain_walk(x, options, beam) for c, x in cells.items()}


def test_numbers_have_no_gap_whatever_the_split(spark):
    rows = [(i % 3, i, f"x{i}") for i in range(1000)] + [(None, -1, "n")]
    for parts, split in ((1, 1), (5, 9), (40, 3)):
        df = spark.createDataFrame(rows, "a int, b int, c string").repartition(split)
        got = numbering.numbered(df, ["a", F.desc("b")], parts=parts).orderBy("n").collect()
        assert [x["n"] for x in got] == list(range(1001))
        assert [(x["a"], x["b"]) for x in got] == sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))
    assert numbering.batched(spark.createDataFrame(rows, "a int, b int, c string").limit(0), ["b"]).count() == 0


def test_alias_tables_are_exact():
    r = random.Random(5)
    for n in (1, 2, 7, 60):
        weights = [r.randrange(1, 50) for _ in range(n)]
        share = [0] * n
        for i, (below, other) in enumerate(grammar.alias(weights)):
            share[i] += below
            share[other] += sum(weights) - below
        assert share == [w * n for w in weights]


def test_grammar_follows_its_shares(spark):
    pools = sorted({i[1:].split("-")[0] for _, _, items in grammar.lines() for i in items if i[0] in "@?"})
    words = spark.createDataFrame([(p, f"{p}{k}x", 1 + k) for p in pools for k in range(3)], "pool string, word string, weight long")
    n = 6000
    got = grammar.expand(spark.range(n).repartition(5).withColumnRenamed("id", "pos"), grammar.lines(), words, "line").collect()
    assert len(got) == n and all(x["text"] for x in got)
    seen = collections.Counter(x["shape"] for x in got)
    for _, weight, (shape, *_) in (r for r in grammar.lines() if r[0] == "line"):
        assert abs(seen[shape] / n - weight / 1000) < 0.02
    texts = [x["text"] for x in got]
    # weighted words: the third is three times as frequent as the first
    count = collections.Counter(w for t in texts for w in ("doc_tail0x", "doc_tail2x") if w in t)
    assert 2.3 < count["doc_tail2x"] / count["doc_tail0x"] < 3.9
    syllables = [c for x in got if x["shape"] == "random" for c in x["text"] if "가" <= c <= "힣"]
    bare = sum((ord(c) - 0xAC00) % 28 == 0 for c in syllables) / len(syllables)
    assert abs(bare - grammar.TAIL[0] / sum(grammar.TAIL)) < 0.03
    again = grammar.expand(spark.range(n).withColumnRenamed("id", "pos"), grammar.lines(), words, "line")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))


def test_lines_of_one_file_are_made_by_many_tasks(spark, monkeypatch):
    made = {}
    kept = grammar.stored
    monkeypatch.setattr(grammar, "stored", lambda df, name: made.setdefault(name, df) and kept(df, name))
    words = spark.createDataFrame([("p", "w", 1)], "pool string, word string, weight long")
    rows = spark.range(500).coalesce(1).withColumnRenamed("id", "pos")
    got = grammar.expand(rows, [("s", 1, ["@p", "^"])], words, "s")
    assert made["parts"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # draws are compiled columns, no arrays that are walked through
    assert "transform(" not in made["parts"]._jdf.queryExecution().optimizedPlan().toString()
    assert all(x["text"][0] == "w" and len(x["text"]) == 2 for x in got.collect()) and got.count() == 500


def test_slots_keep_their_ending_and_marks_go_between_words(spark):
    words = spark.createDataFrame([("verb", "읽는다", 1)], "pool string, word string, weight long")
    rows = spark.range(2000).withColumnRenamed("id", "pos")
    kept = collections.Counter(x["text"] for x in grammar.expand(rows, [("s", 1, ["?verb-2-0"])], words, "s").collect())
    assert 0.65 < kept["읽는다"] / 2000 < 0.75 and all(t.endswith("는다") and len(t) in (3, 4, 5) for t in kept)
    assert all(x["text"] == x["text"].strip("다") for x in grammar.expand(rows.limit(50), [("s", 1, ["?verb-2-2"])], words, "s").collect())
    mark = [("s", 1, ["=\x01", "=+", "=one two three"]), ("s", 1, ["=\x01", "=+", "=single"])]
    assert {x["text"] for x in grammar.expand(rows.limit(40), mark, words, "s").collect()} == {"one + two three", "single"}


def test_grammar_refuses_what_it_cannot_expand(spark):
    with pytest.raises(ValueError, match="itself"):
        grammar.depth([("a", 1, ["b"]), ("b", 1, ["a"])], "a")
    with pytest.raises(ValueError, match="no rule"):
        grammar.alternatives([("a", 1, ["nothing"])])
    words = spark.createDataFrame([("p", "w", 1)], "pool string, word string, weight long")
    with pytest.raises(Exception, match="no words"):
        grammar.expand(spark.range(3).withColumnRenamed("id", "pos"), [("a", 1, ["@other"])], words, "a").collect()


def test_digit_lines(spark):
    words = spark.createDataFrame([("p", "w", 1)], "pool string, word string, weight long")
    got = [x["text"] for x in grammar.expand(spark.range(3000).withColumnRenamed("id", "pos"), grammar.digit_lines(), words, "digit_line").collect()]
    assert all(set(t) <= set("0123456789-./ ") and t[0].isdigit() for t in got)
    assert abs(sum(t.isdigit() and len(t) <= 5 for t in got) / 3000 - 0.35) < 0.12



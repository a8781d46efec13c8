"""The filter audit, vector codes and the chosen-path join against plain versions, and on nulls, empties, ties and clashing columns."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import audit, chosen, codes
from tests.helpers import rows

from .test_llm import DOCS, awkward, clashing
from .test_rules import CLASH, closure, family

LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    bad = {}
    for r in docs:
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = r["doc_id"] is not None and any(o["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == text for o in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": copy}
        good, toxic = (any(x["doc_id"] == r["doc_id"] and x["doc_id"] is not None and x[c] == 1 for x in labels) for c in ("quality", "toxic"))
        bad.setdefault(r["source"] or "", []).append((fails, good, toxic))
    out, worth = [], {}
    for part, group in bad.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [g for g in group if not any(g[0][x] for x in order[: step - 1])]
                gone = [g for g in here if g[0][f]]
                worth[part, f] = worth.get((part, f), 0) + len(gone)
                out.append([part, order, step, len(here) - len(gone), len(gone), sum(g[0][f] for g in group) - len(gone), sum(g[0][f] and sum(g[0].values()) == 1 for g in group), sum(g[1] for g in gone), sum(g[2] for g in gone)])
    return sorted((*o, worth[o[0], o[1][o[2] - 1]]) for o in out)


def test_audit_against_a_plain_count(spark):
    r = random.Random(3)
    more = [(100 + i, " ".join(r.choice(("a", "b", "C", "%", "word", str(i % 7))) for _ in range(r.choice((3, 150, 260)))), "en", r.choice("ab"), 1) for i in range(60)]
    more += [(300 + i, more[i % 4][1], "en", "z", 1) for i in range(40)] + [(-5, more[0][1], "en", "z", 1)]
    docs = awkward(spark).unionByName(spark.createDataFrame(more, DOCS))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (101, 1, 0), (102, 0, 1), (305, 1, 1)], LABELS)
    extra = docs.withColumns({c: docs["n_chars"] for c in ("part", "digest", "fails", "first", "good", "passed", "kept")})
    got = audit.audit(extra, labels.withColumn("good", labels["quality"])).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs.collect(), labels.collect())
    assert audit.audit(docs.limit(0), labels).count() == 0


def test_audit_tells_parts_apart_in_one_block(spark):
    data = [(f"p{i % 700}", i % 32, i % 3 == 0, i % 5 == 0) for i in range(20000)]
    got = audit.counts(spark.createDataFrame(data, "part string, fails int, good boolean, toxic boolean"), 5).where("passed = 5 AND part = 'p7'").collect()
    mine = [x for x in data if x[0] == "p7" and not x[1] & 5]
    assert [tuple(r)[2:] for r in got] == [(len(mine), sum(x[2] for x in mine), sum(x[3] for x in mine))]


def plain_codes(vectors):
    kept = [r for r in vectors if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = -(-max((len(r[2]) for r in kept), default=0) // 16)
    q = [[math.floor(x * 256) for x in r[2]] + [0] * (16 * width - len(r[2])) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, q[i]))[:64]
    parts = [[v[p * width : (p + 1) * width] for v in q] for p in range(16)]
    books = [[list(parts[p][i]) for i in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(3):
        at = [[min(range(len(b)), key=lambda e: (far(v, b[e]), e)) for v in part] for part, b in zip(parts, books, strict=True)]
        if turn == 2:
            break
        for p in range(16):
            for e in range(len(books[p])):
                mine = [v for v, a in zip(parts[p], at[p], strict=True) if a == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    error = [sum(far(parts[p][i], books[p][at[p][i]]) for p in range(16)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for r, e in zip(kept, error, strict=True):
        sums[r[1]] = sums.get(r[1], 0) + e
    return sorted(((r[0], "".join(f"{at[p][i]:02x}" for p in range(16)), error[i], sums[r[1]], digest) for i, r in enumerate(kept)), key=repr)


@pytest.mark.parametrize("rows_", [40, 300])
def test_codes_against_a_plain_version(spark, rows_):
    r = random.Random(rows_)
    data = [(i, r.choice((None, 1, 2)), [r.gauss(0, 0.3) for _ in range(32)]) for i in range(rows_)]
    # copies, ties, a shorter vector, equal and null ids, and what is left out
    data += [(1000 + i, 1, data[3][2]) for i in range(30)] + [(7, 2, data[9][2]), (None, 1, data[4][2]), (2000, 1, [0.5] * 20), (2001, None, [])]
    data += [(-3, 1, None), (-2, 1, [float("nan")] * 32), (-1, 2, [None] + [0.1] * 31), (-4, 1, [float("inf")] * 32)]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").repartition(5)
    stored = [(x["vec_id"], x["label"], x["embedding"]) for x in df.collect()]
    got = codes.compressed(df.withColumns({c: df["label"] for c in ("q", "code", "error", "salt", "of", "turn", "p", "n")})).collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(stored)


def test_codes_of_nothing_and_of_too_much(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert codes.compressed(spark.createDataFrame([], kind)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, 1, None)], kind)).count() == 0
    with pytest.raises(Exception, match="component"):
        codes.compressed(spark.createDataFrame([(1, 1, [1e9] * 16)], kind))


def test_partial_distances_find_the_first_nearest():
    r = np.random.default_rng(5)
    for width in (1, 3, 8):
        book = r.integers(-6, 6, (64, width))
        x = r.integers(-9, 9, (500, width))
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, best = codes.nearest(x, book)
        assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_chosen_paths_against_all_pairs(spark):
    texts = family(4, 25)
    r = random.Random(9)
    # a crowd of near copies of one text, more than a small node
    base = [f"c{r.randrange(10**6)}" for _ in range(150)]
    for _ in range(300):
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = f"d{r.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += ["one two", "ONE two", "one two three", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in chosen.near_duplicates(df.repartition(6)).collect()}
    want = closure_of(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(texts)))


def closure_of(texts):
    return closure([" ".join(f"{k}" for k in t.lower().split()) for t in texts], 0.8, 4)


def test_chosen_paths_on_awkward_rows(spark):
    got = chosen.near_duplicates(clashing(awkward(spark)).withColumns({c: F.lit(1) for c in (*CLASH, "digest", "sketch", "paths", "named", "bytes", "a", "b")})).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert len(got) == awkward(spark).count()
    n = len({*zip(*[(awkward(spark).first()["text"].split())[i:] for i in range(4)])})
    assert by[1] == [(n, 1, True)] and by[2] == [(n, 1, False)] * 2 and by[7] == [(n, 1, False)]
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[None] == [(1, None, True)] and by[6][0][1:] == (6, True)
    assert chosen.near_duplicates(awkward(spark).limit(0)).count() == 0


@pytest.mark.parametrize("large", [8192, 100])
def test_crowded_nodes_are_dealt_on(monkeypatch, large):
    """A node of more rows than a task holds goes on block by block: near copies still end in one group, others stay apart."""
    monkeypatch.setattr(chosen, "LARGE", large)
    r = np.random.default_rng(1)
    base = r.integers(0, 256, (3, chosen.POSITIONS), dtype=np.uint8)
    sketch = base[np.arange(600) % 3].copy()
    off = r.random(sketch.shape) < 0.05
    sketch[off] = r.integers(0, 256, int(off.sum()), dtype=np.uint8)
    keys = [bytes([k // 256, k % 256]) + bytes(14) for k in range(600)]
    root = {k.hex(): k.hex() for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    batch = pa.RecordBatch.from_arrays([pa.array(np.full(600, 77)), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())], names=["path", "key", "sketch"])
    sent = 0
    for out in chosen._searched(False)([batch.slice(0, 350), batch.slice(350)]):
        for x in out.to_pylist():
            if x["b"]:
                a, b = sorted((find(x["a"]), find(x["b"])))
                root[b] = a
            else:
                sent += 1
    assert len({(find(k.hex()), i % 3) for i, k in enumerate(keys)}) == 3
    assert (sent >= 600) == (large == 100)


def test_a_node_crowded_at_every_level_is_compared_whole(spark, monkeypatch):
    """Rows that agree wherever their node branches never part: each is compared with those of other blocks, heads or not."""
    monkeypatch.setattr(chosen, "LARGE", 50)
    taken, waiting = set(), [77]
    for _ in range(7):
        taken.update(p for node in waiting for p in chosen.positions(node))
        waiting = [chosen.mixed(node, p, 0) for node in waiting for p in chosen.positions(node)]
    equal = (sorted(taken) + [p for p in range(chosen.POSITIONS) if p not in taken])[: chosen.FEWEST - 10]
    assert taken <= set(equal)
    r = np.random.default_rng(4)
    sketch = r.integers(0, 256, (300, chosen.POSITIONS), dtype=np.uint8)
    sketch[150:270] = sketch[:120]  # rows 0 to 119 have a twin, 270 to 299 none, 120 to 149 are of one large group with 400 more
    sketch = np.concatenate((sketch, np.repeat(sketch[120:121], 400, axis=0)))
    sketch[120:150] = sketch[120]
    sketch[:, equal] = 0
    keys = [bytes([1 + k * 37 % 250, 1 + k // 250, *[7] * 14]) for k in range(len(sketch))]
    nodes = spark.createDataFrame([(k, s.tobytes(), [77]) for k, s in zip(keys, sketch, strict=True)], "digest binary, sketch binary, paths array<long>")
    root = {x["node"]: x["root"] for x in chosen.candidates(nodes).collect()}
    name = [k.hex() for k in keys]
    group = [root.get(x, x) for x in name]
    assert group[:120] == group[150:270] and len(set(group[:120])) == 120
    assert set(group[120:150] + group[300:]) == {min(name[120:150] + name[300:])}
    assert group[270:300] == name[270:300] and len(set(group)) == 151


def test_trees_reach_the_recall():
    assert chosen.trees(0.999) < chosen.trees(0.9999)
    r = np.random.default_rng(2)
    found = 0
    for _ in range(300):
        a = r.integers(0, 256, chosen.POSITIONS, dtype=np.uint8)
        b = np.where(r.random(chosen.POSITIONS) < chosen.THRESHOLD, a, a ^ 1)
        found += any(meets(a, b, chosen.mixed(int(r.integers(1 << 40))), chosen.LEVELS) for _ in range(chosen.trees()))
    assert found >= 298


def meets(a, b, node, levels):
    return levels == 0 or any(a[p] == b[p] and meets(a, b, chosen.mixed(node, p, int(a[p])), levels - 1) for p in chosen.positions(node))


def test_queries_follow_sql(spark):
    from glyphlake.llm import queries
    from tests.helpers import SF, by_sql

    for name in ("op11_filter_interaction_audit", "op12_vector_codes", "op13_chosen_path_near_dedup"):
        assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(by_sql(queries.ORACLE_SQL[name]))

"""Results that don't hang on ids, splits, ties, names or the size of a part; brute-force versions of what SQL can't say."""

import collections
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import common, decontaminate, eliasfano, mixing, neighbours, passages, quality, queries, sharding, simhash, warc
from tests.helpers import SF, by_sql

from .test_llm import DOCS, awkward

CLASH = ("row", "key", "turn", "k", "part", "shard_", "__s", "__p", "__k", "__part", "__start", "__id", "__turn", "whole", "size", "copies", "taken", "target", "source_size", "rank", "rate", "cut", "spans", "f", "score", "n", "root", "cluster")


def words(r, n):
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def shingles(text, n=5):
    w = text.lower().split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def closure(texts, least=0.8, n=5):
    """Smallest index of each text's cluster, by all pairs."""
    sets, root = [shingles(t, n) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def family(seed, groups=12):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = words(r, r.randrange(60, 260))
        out.append(base)
        for _ in range(r.randrange(0, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = words(r, 1)[0]
            out.append(t)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("pack", [1 << 21, 3000])
def test_near_dedup_stage_against_all_pairs(spark, monkeypatch, pack):
    monkeypatch.setattr(simhash, "PACK", pack)
    texts = family(1)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in simhash.stage(spark, df, SF).select("doc_id").collect()}
    roots = closure(texts)
    sets = [shingles(t) for t in texts]
    # nothing goes without a near copy, and copies that differ in under 28 of 128 bits (nearly all) leave one row
    assert kept >= set(roots) and len(kept) - len(set(roots)) <= 1
    for i in set(range(len(texts))) - kept:
        assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(texts)) if j != i) >= 0.8


def test_near_dedup_stage_judges_texts_and_not_ids(spark):
    r = random.Random(1)
    own = [(None, " ".join(words(r, 60)), "en", "a", 1) for _ in range(5)] + [(9, " ".join(words(r, 60)), "en", "a", 1) for _ in range(3)]
    assert simhash.stage(spark, spark.createDataFrame(own, DOCS), SF).count() == 8
    same = [(i, own[0][1], "en", "a", 1) for i in (None, None, 7, 5, 5)] + [(None, None, None, None, None), (3, "", "en", "b", 0), (4, " \n", "en", "b", 0)]
    got = simhash.stage(spark, spark.createDataFrame(same, DOCS), SF).collect()
    assert sorted(x["doc_id"] for x in got) == [3, 5]


def stages():
    return {"quality": quality.stage, "near-dedup": simhash.stage, "decontamination": decontaminate.stage, "mixing": mixing.stage, "sharding": sharding.stage}


@pytest.mark.parametrize("name", stages())
def test_stages_keep_columns_of_any_name(spark, name):
    df = awkward(spark)
    out = stages()[name](spark, df.withColumns({c: F.lit("mine") for c in CLASH}), SF)
    wanted = [*df.columns, *CLASH]
    assert out.columns[: len(wanted)] == wanted and all(r[c] == "mine" for r in out.collect() for c in CLASH)
    assert stages()[name](spark, df.limit(0), SF).collect() == []


def test_neighbours_of_scaled_and_rounded_copies(spark, tmp_path):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(8)
    data = [(i, (v * 2.0 ** (i % 40 - 20)).tolist()) for i in range(120)] + [(i, (v * 3.0 * i).tolist()) for i in range(120, 160)]
    data += [(200 + i, w.tolist()) for i, w in enumerate(np.eye(8)[rng.integers(0, 8, 100)])] + [(400 + i, w.tolist()) for i, w in enumerate(rng.choice([-1.0, 1.0], (150, 3)))]
    pd.DataFrame(data, columns=["vec_id", "embedding"]).to_parquet(tmp_path / "embeddings.parquet")
    df = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), shard_rows=70).toPandas()
    want = by_sql(neighbours.ORACLE_OP7, str(tmp_path))
    pick = lambda d: sorted(map(tuple, d[["query_id", "rank", "vec_id"]].itertuples(index=False)))
    assert pick(got) == pick(want)


def test_mixing_takes_documents_at_their_rates(spark):
    base = spark.createDataFrame([(i, "a" if i % 3 else "b", (i * 37) % 500) for i in range(600)], "doc_id long, source string, size long").withColumn("step", mixing.step_of(F.col("size"))).cache()
    sums = base.groupBy("source", "step").agg(F.sum("size").cast("long").alias("words"))
    goals = mixing.targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    rated = mixing.rates(sums.join(goals, "source")).collect()
    rate = {(r["source"], r["step"]): r["rate"] for r in rated}
    for s in "ab":
        mine = [r for r in rated if r["source"] == s]
        assert sum(r["rate"] * r["words"] for r in mine) == pytest.approx(mine[0]["target"])
    took, draws = collections.Counter(), 8
    for seed in range(draws):
        for r in mixing.mix(base, seed=seed).select("source", "step", "copies").collect():
            took[r["source"], r["step"]] += r["copies"]
    docs = collections.Counter((r["source"], r["step"]) for r in base.collect())
    big = [k for k in docs if docs[k] >= 30]
    assert len({round(rate[k], 3) for k in big}) > 2
    assert all(abs(took[k] / draws / docs[k] - rate[k]) < 0.1 for k in big)
    hot = [(1, "a", 50)] * 400 + [(i, "b", 40) for i in range(2, 100)]
    out = mixing.mix(spark.createDataFrame(hot, "doc_id long, source string, size long")).collect()
    a = [r for r in out if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in a) - a[0]["target"]) < 0.1 * a[0]["target"]


def test_sharding_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op2_rendezvous_sharding"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)


def test_decontamination_in_parts(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, decontaminate.scan(docs, bench).collect()))
    assert whole == sorted(map(str, decontaminate.scan(docs, bench, part_nodes=60000).collect()))
    kept = [sorted(map(str, decontaminate.stage(spark, docs, "/root/testdata/sf0.01", n).collect())) for n in (1 << 22, 60000)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


def best_score(a, cost, gap):
    """Best chain score by comparing every pair of anchors."""
    score = a[:, 2].astype(float)
    for j in range(len(a)):
        for i in range(j):
            dx, dy = a[j, 0] - a[i, 0] - a[i, 2], a[j, 1] - a[i, 1] - a[i, 2]
            if a[i, 0] < a[j, 0] and a[i, 1] < a[j, 1] and max(dx, dy) <= gap:
                score[j] = max(score[j], score[i] + a[j, 2] - max(0, -min(dx, dy)) - cost * (max(dx, 0) + max(dy, 0)))
    return score.max()


def chain_score(c, cost):
    total = float(c[0, 2])
    for p, q in zip(c, c[1:], strict=False):
        dx, dy = q[0] - p[0] - p[2], q[1] - p[1] - p[2]
        total += q[2] - max(0, -min(dx, dy)) - cost * (max(dx, 0) + max(dy, 0))
    return total


def test_chains_are_the_best_within_the_gap():
    r = random.Random(3)
    for _ in range(300):
        a = np.array(sorted({(r.randrange(300), r.randrange(300), r.randint(1, 30)) for _ in range(r.randrange(1, 25))}))
        top = max(chain_score(c, passages.GAP_COST) for c in passages.chains_of(a))
        assert top == pytest.approx(best_score(a, passages.GAP_COST, passages.GAP))


def test_passages_do_not_depend_on_the_split(spark):
    r = random.Random(8)
    text = lambda *parts: " ".join(w for p in parts for w in p)
    shared, other = words(r, 60), words(r, 150)
    data = [(i, text(words(r, r.randrange(30)), shared, words(r, r.randrange(30)))) for i in range(40)]
    data += [(i, text(words(r, 10), [w if r.random() > 0.05 else words(r, 1)[0] for w in other], words(r, 10))) for i in range(50, 75)]
    data += [(80, "same " * 300), (81, "same " * 200), (82, "a b c " * 120), (83, "a b c " * 90)]
    rows = [sorted(map(tuple, passages.repeated(spark.createDataFrame(data, "doc_id long, text string").repartition(n)).collect())) for n in (1, 3, 45)]
    assert rows[0] == rows[1] == rows[2]
    assert {x[0] for x in rows[0]} == set(range(1, 40)) | set(range(51, 75)) | {81, 83}


def test_passage_after_a_longer_one_and_with_words_added(spark):
    r = random.Random(5)
    long, short = words(r, 200), words(r, 120)
    with_pairs = [w for k, v in enumerate(short) for w in ([*words(r, 2), v] if k and k % 20 == 0 else [v])]
    with_ones = [w for k, v in enumerate(short) for w in ([*words(r, 1), v] if k and k % 24 == 0 else [v])]
    cases = [(long + words(r, 100) + short, long + words(r, 100) + with_pairs, [200, 130]), (words(r, 30) + short, words(r, 10) + with_ones, [124])]
    for a, b, sizes in cases:
        got = passages.repeated(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")).orderBy("start").collect()
        assert [x["n_words"] for x in got] == sizes


def test_fuzzy_passages_are_found(spark):
    r = random.Random(6)
    for identity, n, least in ((0.95, 60, 0.95), (0.9, 120, 0.95), (0.85, 250, 0.9)):
        rows = []
        for i in range(60):
            p = words(r, n)
            q = [w if r.random() < identity else words(r, 1)[0] for w in p]
            rows += [(2 * i, " ".join(words(r, 20) + p)), (2 * i + 1, " ".join(words(r, 9) + q))]
        got = passages.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len({x["doc_id"] for x in got}) >= least * 60 and all(x["other_id"] == x["doc_id"] - 1 for x in got)


def test_trie_looks_inside_a_context_only(tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = np.unique(rng.integers(1, 2**63, 60, dtype=np.uint64))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, len(vocabulary), (400, 2)) if a % 3})
    counts = rng.integers(1, 9, len(pairs))
    t = eliasfano.Trie.build(vocabulary, np.full(len(vocabulary), 5_000_000_000, np.int64), np.array([p[0] for p in pairs]), vocabulary[[p[1] for p in pairs]], counts, 0.75)
    m = eliasfano.Trie.read(eliasfano.mapped(t.to_bytes()))
    every = [(a, b) for a in range(len(vocabulary)) for b in range(len(vocabulary))]
    got = m.book[m.follow(vocabulary[[a for a, _ in every]], vocabulary[[b for _, b in every]])]
    total = collections.Counter()
    for (a, _), c in zip(pairs, counts.tolist(), strict=True):
        total[a] += c
    want = {p: (c - 0.75) / total[p[0]] for p, c in zip(pairs, counts.tolist(), strict=True)}
    assert got == pytest.approx([want.get(p, 0) for p in every], rel=0.02)
    assert m.look(vocabulary)[0].tolist() == [5_000_000_000] * len(vocabulary)


def test_ridge_and_isotonic_against_plain_versions(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, len(quality.NAMES)))
    y = (x[:, 0] + 0.5 * rng.standard_normal(300) > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "f array<double>, y double").repartition(5)
    model = quality.fit(rows, d=40)
    z = model.map(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(x) * np.eye(41) / 41, z.T @ y)
    assert model.beta == pytest.approx(want, rel=1e-6, abs=1e-8) and model.mean == pytest.approx(x.mean(axis=0))
    for _ in range(20):
        good, count = rng.integers(0, 10, 15).astype(float), np.full(15, 9.0)
        good = np.minimum(good, count)
        at, share = quality.isotonic(np.arange(15.0), good, count)
        blocks = [[g, c] for g, c in zip(good, count, strict=True)]
        while any(a[0] / a[1] >= b[0] / b[1] for a, b in zip(blocks, blocks[1:], strict=False)):
            k = next(k for k in range(len(blocks) - 1) if blocks[k][0] / blocks[k][1] >= blocks[k + 1][0] / blocks[k + 1][1])
            blocks[k : k + 2] = [[blocks[k][0] + blocks[k + 1][0], blocks[k][1] + blocks[k + 1][1]]]
        assert share == pytest.approx([g / c for g, c in blocks])


def test_empty_tables(spark, tmp_path):
    from glyphlake.llm import extract, lm

    docs = awkward(spark).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert quality.statistics(docs).collect() == [] and lm.score(docs.withColumn("train", F.lit(True)), shards=2).collect() == []
    path = warc.write_archive(pages, str(tmp_path / "w"))
    assert warc.records(spark, path).collect() == []
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    for t in ("labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert extract and all(q(spark, str(tmp_path)).collect() == [] for q in queries.QUERIES.values())


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = simhash.stage(spark, docs, sf).select("doc_id", "text").collect()
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    left = {r["doc_id"] for r in once}
    sets = {i: shingles(t or "") for i, t in texts.items()}
    holders = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i in set(texts) - left:
        near = collections.Counter(j for x in sets[i] for j in holders[x] if j != i)
        assert any(n / len(sets[i] | sets[j]) >= 0.8 for j, n in near.items()) or not sets[i]
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality classifier", "simhash near-dedup"]
    assert np.isfinite(quality.features_of(pa.array(["a"]))).all()


@pytest.mark.parametrize("before", ["<datalist><option value=a>x<option value=b>y</datalist>", "<div><button>go</div>", "<object data=x>", "<div><object data=x><div>instead</div></object></div>", "<select><option>one<option>two</select>", "<div><noscript>off</div>", "<svg><text>drawn"])
def test_unclosed_controls_hide_no_article(before):
    from glyphlake.llm import extract

    prose = "This is a sentence of the article that goes on for a while. " * 5
    text = extract.main_text(f"<body>{before}<article><h1>Head</h1><p>{prose}</p><p>{prose}</p></article></body>", extract.trained())
    assert text == f"Head\n\n{prose.strip()}\n\n{prose.strip()}"


def test_mixing_does_not_depend_on_the_split(spark):
    rows = [(7, "one two three", "en", "a", 1)] * 200 + [(7, "six five four", "en", "a", 1)] * 3 + [(i, "w " * (i % 40), "en", "ab"[i % 2], 1) for i in range(100)]
    seen = set()
    for parts in (1, 7, 40):
        df = spark.createDataFrame(rows, DOCS).repartition(parts)
        got = mixing.mix(df.select("doc_id", "text", "source", mixing.word_count(F.col("text")).alias("size")))
        seen.add(str(sorted(map(str, got.collect()))))
    assert len(seen) == 1
    assert got.count() == len(rows)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("want")).collect():
        assert abs(r["t"] - r["want"]) <= 80


def test_extraction_of_given_pages(spark):
    """The given pages put the article into an element of its name: its words, and nothing else."""
    import html
    import re

    from glyphlake.llm import extract

    right = []
    got = {r["page_id"]: r["text"] for r in extract.op4_crf_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        if inner:
            plain = re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style)\b.*?</\1>", "", inner[1], flags=re.S))
            right.append(html.unescape(plain).split() == got[r["page_id"]].split())
    assert len(right) > 30 and sum(right) >= 0.98 * len(right)


@pytest.mark.parametrize("parts", [1, 5])
def test_passages_whose_seeds_all_are_crowded(spark, parts):
    r = random.Random(3)
    own = lambda n: words(r, n)
    head, tail, mid = own(12), own(12), own(40)
    data = [(i, " ".join(own(30) + (head if i % 2 else tail) + own(30))) for i in range(12)]
    data += [(20, " ".join(own(30) + head + mid + tail + own(20))), (21, " ".join(own(10) + head + [w if k % 8 else own(1)[0] for k, w in enumerate(mid)] + tail + own(30)))]
    got = passages.repeated(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
    assert [(x["doc_id"], x["other_id"], x["n_words"]) for x in got] == [(21, 20, 64)]


def test_surroundings_that_match_are_never_ruled_out():
    r, size, side = random.Random(4), 50, 50 - passages.K
    for _ in range(200):
        a = [r.randrange(1, 256) for _ in range(side)], [r.randrange(1, 256) for _ in range(side)]
        left, b, spare = r.randrange(side + 1), [], 10
        for part, n in zip(a, (left, side - left), strict=True):
            out, extra = [], 0
            for v in part[:n]:
                kind = r.randrange(4) if spare else 3
                spare -= kind < 3
                extra += kind == 1
                out += [[0], [0, v], [], [v]][kind]
            b.append((out + [0] * side)[:side])
        row = lambda p: np.array([p[0] + p[1]], np.uint8)
        kept = sum(v in p for p, v in ((b[k], v) for k, n in ((0, left), (1, side - left)) for v in a[k][:n]))
        if kept >= 32:
            assert passages.may_pass(row(a), row(b), size, 0.8).all()
    far = np.array([[r.randrange(1, 256) for _ in range(2 * side)] for _ in range(40)], np.uint8)
    assert passages.may_pass(far, far, size, 0.8).diagonal().all() and passages.may_pass(far, far, size, 0.8).sum() < 60


def test_elias_fano_selects_by_one_pass():
    r = np.random.default_rng(7)
    for values in (r.integers(0, 1 << 40, 3000), r.integers(0, 50, 900), np.zeros(5, int), np.array([2**63 + 5]), np.arange(700)):
        values = np.sort(values.astype(np.uint64))
        e, _ = eliasfano.EliasFano.read(eliasfano.EliasFano.of(values).to_bytes())
        high = (values >> np.uint64(e.low_bits)).astype(np.int64)
        assert e.highs.tolist() == high.tolist()
        assert e.starts[: high[-1] + 2].tolist() == np.searchsorted(high, np.arange(high[-1] + 2)).tolist()
        assert np.array_equal(e.get(np.arange(len(values))), values) and np.array_equal(values[e.find(values)], values)
        assert (e.find(np.array([int(values[-1]) + 1, 2**64 - 1], np.uint64)) == -1).all()


def test_contexts_that_were_found_are_not_searched_again(monkeypatch):
    words = np.array([3, 9, 20], np.uint64)
    t = eliasfano.Trie.build(words, np.array([4, 2, 1]), np.array([0, 0, 2]), np.array([9, 20, 3], np.uint64), np.array([3, 1, 1]), 0.75)
    t = eliasfano.Trie.read(t.to_bytes())
    contexts, after = np.array([3, 4, 20], np.uint64), np.array([3, 9, 20], np.uint64)
    at = t.words.find(contexts)
    children, which = np.array([2, 1, 1]), np.array([1, 2, 1, 0])
    look, fan = t.look(contexts), t.fan(contexts, children, after, which)
    monkeypatch.setattr(t, "words", None)
    assert all(np.array_equal(a, b) for a, b in zip(look, t.look(contexts, at), strict=True))
    assert np.array_equal(fan, t.fan(contexts, children, after, which, at)) and (fan > 0).tolist() == [True, True, False, True]


def test_a_shared_line_is_compared_once_and_not_at_each_of_its_seeds(spark):
    """Matches of a line of many seeds come from its first seed and reach to its last; a passage around it is still found."""
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    line = [word() for _ in range(30)]
    near_by = [word() for _ in range(30)]
    texts = [[word() for _ in range(60)] + line + [word() for _ in range(60)] for _ in range(40)]
    for k in (31, 37):
        texts[k][30:60] = near_by
    texts[37][33] = texts[37][47] = "other"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    word, first = passages._coded(pa.array([" ".join(t) for t in texts]))
    doc, x, key = passages.seeds_of(word, first)
    inside = (x >= 60) & (x + passages.K <= 90)
    seeds = len(np.unique(key[inside]))
    places = spark.createDataFrame([(int(k), int(d), int(p)) for k, d, p in zip(key[inside], doc[inside], x[inside], strict=True)], "key long, doc long, x int")
    got = {tuple(v) for v in passages.crowded(docs, places).collect()}
    both = sorted(set(x[inside & (doc == 31)].tolist()) & set(x[inside & (doc == 37)].tolist()))
    assert seeds > 3 and len(both) > 3 and got == {(37, 31, both[0], both[0], both[-1] - both[0] + passages.K)}
    found = [v for v in passages.repeated(docs).collect() if (v["doc_id"], v["other_id"]) == (37, 31)]
    assert [v["n_words"] for v in found] == [60]


def test_pairs_of_surroundings_are_ruled_out_by_two_word_runs():
    r, size, side = random.Random(7), 50, 50 - passages.K
    one = [r.randrange(1, 256) for _ in range(2 * side)]
    # ten words added on one side and ten on the other, all apart: the most breaks that 40 matched words of 50 may have
    left, right = [v for k, v in enumerate(one[:32]) for v in ([v, 0] if k % 4 == 0 else [v])], [v for k, v in enumerate(one[:32]) for v in ([v, 0] if k % 4 == 2 else [v])]
    fill = lambda p: [v or r.randrange(1, 256) for v in (p + [0] * 2 * side)[: 2 * side]]
    a, b = (np.array([fill(p[:side])], np.uint8) for p in (left, right))
    assert [len(v) for v in passages.near(passages.sketch(a, side), passages.sketch(b, side), size, 0.8)] == [1, 1]
    far = np.array([[r.randrange(1, 256) for _ in range(2 * side)] for _ in range(60)], np.uint8)
    drawn = passages.sketch(far, side)
    p, q = passages.near(drawn, drawn, size, 0.8)
    assert set(zip(range(60), range(60), strict=True)) <= set(zip(p.tolist(), q.tolist(), strict=True)) and len(p) < 200


def test_occurrences_travel_packed_and_shuffle_files_go(spark, tmp_path):
    r = random.Random(2)
    data = [(i, " ".join(words(r, 300))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    parts = passages.PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # some 4,000 seeds and 15,000 runs
    assert 0 < passages.found(docs).count() <= 2 * parts * docs.rdd.getNumPartitions()
    before = spark.conf.get(common.CLEANUP)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    got = common.kept(docs.repartition(4, "doc_id").groupBy("text").count(), "grouped")
    assert got.count() == 60 and spark.conf.get(common.CLEANUP) == before
    assert tracker.shuffleStatuses().size() <= held + 1


def test_alignment_is_the_same_whatever_was_extended_before():
    r = random.Random(11)
    for _ in range(100):
        base = [r.randrange(200) for _ in range(150)]
        a, b = np.array([v if r.random() < 0.9 else r.randrange(200) for v in base]), np.array([v for v in base if r.random() < 0.95])
        known = {}
        for x, y in ((5, 5), (60, 57), (100, 95)):
            alone = passages.aligned(np.array([(x, y, 4)]), a, b, 0, 0)
            assert passages.aligned(np.array([(x, y, 4)]), a, b, 0, 0, known).tolist() == alone.tolist()

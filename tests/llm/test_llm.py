"""Each operator against a brute-force version or an exact round trip, and on nulls, empties, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphlake.llm import components, decontaminate, eliasfano, extract, lm, mixing, neighbours, pages, passages, quality, queries, sharding, simhash, warc
from tests.helpers import SF, by_sql, rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x" for i in range(30000))


def awkward(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from here again"
    data = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "lone text here", "en", "b", 1), (5, "   \n\t ", "fr", None, 3), (6, LONG, "en", "a", 9), (7, base.upper(), "en", "c", 7), (8, "ünï cödé — 漢字", "xx", "c", 1)]
    return spark.createDataFrame(data, DOCS)


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("size", "shard", "slot", "copies", "taken", "target", "source_size", "fingerprint", "component_id", "score", "f")})


def fold(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        assert rows(got) == rows(by_sql(queries.ORACLE_SQL[name]))


def slow_print(text, words, seed=42):
    w = fold(text)
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_groups(prints, most):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_covering_masks():
    m = simhash.masks(4)
    assert len(m) == 31
    rng = random.Random(1)
    for _ in range(300):
        d = np.uint64(sum(1 << b for b in rng.sample(range(64), 4)))
        assert ((m[:, 0] & d) == 0).any()


def test_distinct_shingles(monkeypatch):
    texts = ["a b c d e f g", "x " * 900 + "a b c d", None, "", "Short", "p q r s t u " * 40]
    want = []
    for text in texts:
        w = (text or "").lower().split()
        each = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        row = []
        for lane in range(2):
            h = [xxhash.xxh64_intdigest(s.encode(), 42 + lane) for s in each]
            row.append(sum(1 << bit for bit in range(64) if sum(v >> bit & 1 for v in h) * 2 > len(h)))
        want.append(row)
    for chunk in (1 << 19, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert simhash.fingerprints_of(pa.array(texts), 5, 2, True).tolist() == want


def test_stage_keeps_texts_that_share_a_repeated_word(spark):
    heads = [" ".join(f"{c}{k}" for k in range(40)) for c in "uvw"]
    df = spark.createDataFrame([(i, h + " the" * 900, "s", "en", 1) for i, h in enumerate(heads)], "doc_id long, text string, source string, lang string, n_chars long")
    assert simhash.stage(spark, df, SF).count() == 3


def test_simhash_against_all_pairs(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 10
    texts = {r["doc_id"]: r["text"] for r in awkward(spark).collect() if r["doc_id"] is not None}
    prints = {i: slow_print(t, 4) for i, t in texts.items()}
    groups = slow_groups(prints, 4)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == groups[r["doc_id"]]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_crowded_bucket_and_components(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = [centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(300)]
    prints = {int(x): int(x) for x in [*near, *rng.integers(0, 2**63, 200, dtype=np.uint64)]}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "lane0 long")
    linked = {int(r["node"], 16): int(r["root"], 16) for r in simhash.groups(df, 1, 4).collect()}
    want = slow_groups(prints, 4)
    assert {x: linked.get(x, x) for x in prints} == want
    chain = spark.createDataFrame([(str(i + 100), str(i + 101)) for i in range(60)], "a string, b string")
    assert {r["root"] for r in components.components(chain).collect()} == {"100"}


def test_near_dedup_stage(spark):
    out = simhash.stage(spark, awkward(spark), SF)
    assert out.columns == awkward(spark).columns
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert 1 in ids and 2 not in ids and len(ids) == len(set(ids))


def test_sharding_law(spark):
    docs = spark.createDataFrame([(i,) for i in range(4000)] + [(None,), (7,), (7,)], "doc_id long")
    out = sharding.numbered(sharding.place(sharding.place(clashing(docs), "doc_id", [1.0] * 16), "doc_id", [1.0] * 17, "grown"), ["doc_id"]).collect()
    assert len(out) == 4003 and all(r["grown"] in (r["shard"], 16) for r in out)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    heavy = collections.Counter(r["shard"] for r in sharding.place(docs, "doc_id", [3.0, 1.0]).collect())
    assert 0.70 < heavy[0] / 4003 < 0.80
    assert sharding.numbered(sharding.place(spark.createDataFrame([], "doc_id long"), "doc_id", [1.0]), ["doc_id"]).collect() == []


def slow_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a", "b", "c", "d", "é", None]), rng.randint(0, 400)) for i in range(3000)] + [(None, "a", 10), (5, "zero", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").withColumn("taken", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(docs) and sorted(map(str, out)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    sizes = collections.Counter()
    for _, s, n in docs:
        sizes[s] += n
    want, took = slow_targets(dict(sizes)), collections.Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 400 for s in want)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).collect() == []
    staged = mixing.stage(spark, awkward(spark), SF)
    assert staged.columns == awkward(spark).columns and staged.count() > 0


def test_decontamination(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "Short One"), (2, "Short One"), (3, None), (4, "..."), (None, "null item words")]
    docs = [(10, "x A-B c, d e f g h i j k z"), (11, None), (12, ""), (13, "short\none two short ONE"), (14, "shortone"), (15, "null item words"), (10, LONG)]
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    first = by[10, 13]
    assert first["n_hit"] == 11 and first["n_items"] == 1 and first["items"] == ["1"]
    assert docs[0][1][first["spans"][0]["start"] : first["spans"][0]["end"]] == "A-B c, d e f g h i j k"
    assert by[13, 5]["n_hit"] == 4 and by[11, 0]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[15, 3]["contaminated"] and by[15, 3]["n_items"] == 0 and not by[14, 1]["contaminated"]
    small = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_nodes=400).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    clean = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect()
    assert not any(r["contaminated"] for r in clean)


def test_quality(spark):
    x = quality.features_of(__import__("pyarrow").array([None, "", "Hello world. Again", LONG]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    one = [quality.features_of(__import__("pyarrow").array([t]))[0] for t in ("Hello world. Again", LONG)]
    assert np.allclose(x[2:], one)
    at, share = quality.isotonic(np.arange(6.0), np.array([0, 2, 1, 3, 2, 4.0]), np.full(6, 4.0))
    assert (np.diff(share) > 0).all()
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_quality_rff_ridge"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    stats = quality.statistics(awkward(spark))
    assert quality.scored(stats, quality.train(stats, spark.createDataFrame([], "doc_id long, quality int"))).count() == 10
    out = quality.stage(spark, clashing(spark.read.parquet(f"{sf}/documents.parquet")), sf)
    assert 700 < out.count() < 1000


def test_quality_stage_draws_labels(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    whole = {r.doc_id for r in quality.stage(spark, docs, sf).select("doc_id").collect()}
    monkeypatch.setattr(quality, "STAGE_LABELS", 150)
    drawn = {r.doc_id for r in quality.stage(spark, docs, sf).select("doc_id").collect()}
    assert len(whole ^ drawn) < 0.05 * docs.count()
    assert np.mean([(i in drawn) == (q == 1) for i, q in labels.items()]) > 0.9


def test_extraction():
    chain = extract.trained()
    held = extract.labelled(range(20000, 20150))
    right = [a == b for f, labels in held for a, b in zip(chain.decode(f), labels, strict=True)]
    assert np.mean(right) > 0.99
    assert all([b[0] for b in extract.leaf_blocks(pages.Page(s).html)] == [b[0] for b in pages.Page(s).blocks] for s in range(50))
    html = "<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One  two&nbsp;three.<p>Four <b>five</b><br>six.<script>x='<p>'</script></article><div class=comments><p>Nice one.</p></div><footer>&copy; Me</footer><p unclosed"
    assert extract.main_text(html, chain) == "A & B\n\nOne two three.\n\nFour five six."
    assert [extract.main_text(x, chain) for x in (None, "", "<", "<!--", "</p>", "<script>")] == [""] * 6


def test_extraction_viterbi_is_best():
    rng = random.Random(4)
    chain = extract.Chain({f"f{k}": rng.gauss(0, 1) for k in range(9)}, np.array([[0.3, -0.4], [-0.2, 0.5]]), np.array([0.1, -0.1]))
    for _ in range(30):
        f = [[f"f{rng.randrange(9)}" for _ in range(3)] for _ in range(6)]

        def value(y):
            return chain.first[y[0]] + sum(chain.turns[a][b] for a, b in zip(y, y[1:], strict=False)) + sum(sum(chain.weights[x] for x in r) for r, label in zip(f, y, strict=True) if label)

        best = max(value([m >> k & 1 for k in range(6)]) for m in range(64))
        assert value(chain.decode(f)) == pytest.approx(best)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 5), (1000, 2000), (5000, 2**63)):
        x = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e, _ = eliasfano.EliasFano.read(eliasfano.EliasFano.of(x).to_bytes())
        q = np.concatenate((x, rng.integers(0, top, 300, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        at = dict(zip(x.tolist(), range(len(x)), strict=True))
        assert e.find(q).tolist() == [at.get(v, -1) for v in q.tolist()] and (e.get(np.arange(len(x))) == x).all()


def test_trie_maps_from_file(tmp_path):
    words = np.array([3, 9, 20], np.uint64)
    t = eliasfano.Trie.build(words, np.array([4, 2, 1]), np.array([0, 0, 2]), np.array([9, 20, 3], np.uint64), np.array([3, 1, 1]), 0.75)
    (tmp_path / "t").write_bytes(t.to_bytes())
    m = eliasfano.Trie.read(np.memmap(tmp_path / "t", np.uint8, "r"))
    assert m.look(np.array([3, 4], np.uint64))[0].tolist() == [4, 0]
    p = m.book[m.follow(np.array([3, 3, 9], np.uint64), np.array([9, 3, 9], np.uint64))]
    assert p[0] == pytest.approx(2.25 / 4, rel=1e-3) and p[1] == p[2] == 0


def test_language_model(spark):
    docs = [r for r in awkward(spark).collect()] + [(i, " ".join(random.Random(i).choices("ab cd ef gh ij kl".split(), k=40)), "en", "s", 1) for i in range(20, 60)]
    df = spark.createDataFrame([tuple(r) for r in docs], DOCS).withColumn("train", F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 10 != 0)
    train = [fold(r["text"]) + [None] for r in df.collect() if r["train"]]
    c = collections.Counter(w for t in train for w in t)
    grams, after, kinds = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        for i, w in enumerate(t):
            for h in (("<s>", *t)[i : i + 1], tuple(t[i - 2 : i]) if i > 1 else ("<s>", t[0]) if i == 1 else ()):
                if h:
                    grams[h, w] += 1
    for (h, _), k in grams.items():
        after[h] += k
        kinds[h] += 1
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(h, w):
        if not h:
            return base(w)
        lower = p(h[1:], w)
        return lower if not after[h] else max(grams[h, w] - 0.75, 0) / after[h] + 0.75 * kinds[h] / after[h] * lower

    texts = collections.defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(r["text"])
    for order in (2, 3):
        out = lm.score(df, shards=5, order=order).collect()
        assert len(out) == len(docs)
        for r in out:
            t = fold(texts[r["doc_id"]][0]) + [None]
            assert r["n_tokens"] == len(t) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in t)
            assert r["base_score"] == pytest.approx(sum(math.log10(base(w)) for w in t), rel=1e-9)
            said = ["<s>", *t]
            assert r["score"] == pytest.approx(sum(math.log10(p(tuple(said[max(0, i - order + 2) : i + 1]), w)) for i, w in enumerate(t)), abs=0.02 * len(t))
    assert lm.score(df.limit(0), shards=3).collect() == []
    bare = spark.createDataFrame([(1, "", True), (2, None, True), (3, "", False)], "doc_id long, text string, train boolean")
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(bare, shards=3).collect()} == {(1, 1, 1, 2), (2, 1, 1, 2), (3, 1, 1, 2)}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    data = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))] + [(600 + i, [1.0] * 8) for i in range(40)]
    data += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [None] * 8), (1050, [1.0, 2.0]), (600, [1.0] * 8)]
    df = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), shard_rows=150, block_rows=4).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    full = {i: np.array(v) for i, v in data if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in full if i % 50 == 0]:
        a = full[q]
        want = sorted(((-float(neighbours.cosine(a[None], b[None])[0]), i) for i, b in full.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert 1050 not in got
    assert neighbours.search(df.where("false"), df.where("false")).collect() == []


def test_relaxed_pruning_trades_recall():
    x = neighbours.unit(np.random.default_rng(6).standard_normal((3000, 4)))
    tree = neighbours.Tree(x, leaf=32)
    exact, _, all_seen = tree.search(x[:50], 5)
    near, _, seen = tree.search(x[:50], 5, 2.0)
    assert np.allclose(np.sort(exact, axis=1), np.sort(neighbours.distances(x[:50], x), axis=1)[:, :5], atol=1e-6) and seen < all_seen < 50 * 3000
    assert (near.max(axis=1) >= exact.max(axis=1) - 1e-9).all()


def test_warc_round_trip(spark, tmp_path):
    data = [(1, "http://a", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 100000), (5, "http://f", "x" * 100000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    path = warc.write_archive(df, str(tmp_path / "a"))
    heads = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_headers(spark, path).collect()}
    assert heads == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "revisit", 5)}
    assert warc.read_payloads(spark, path).count() == 3
    found = collections.defaultdict(list)
    for r in warc.records(spark, path).collect():
        found[r["page_id"]].append(bytes(r["record"]))
    head, _, body = found[2][0].partition(b"\r\n\r\n")
    block = body[: int(re.search(rb"Content-Length: (\d+)", head)[1])]
    assert block.endswith("<p>é</p>".encode()) and body[len(block) :] == b"\r\n\r\n" and found[1][0].endswith(b"\r\n\r\n\r\n\r\n")
    warc.write_archive(df.limit(0), str(tmp_path / "b"))
    assert warc.read_headers(spark, str(tmp_path / "b")).collect() == []


def test_warc_least_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    path = warc.write_archive(df, str(tmp_path / "a"), least=3)
    assert {r["record_type"] for r in warc.read_headers(spark, path).collect()} == {"response"}


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(70)]
    fuzzy = [word() if i in (25, 45) else w for i, w in enumerate(passage)]
    fill = lambda n: [word() for _ in range(n)]
    docs = [(1, " ".join(fill(80) + passage + fill(30))), (2, " ".join(fill(10) + fuzzy + fill(90))), (3, " ".join(fill(200))), (4, None), (5, ""), (None, " ".join(passage)), (6, " ".join(passage[:30] + fill(50))), (7, "same " * 300), (7, "same " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = passages.repeated(df).collect()
    assert [(r["doc_id"], r["other_id"]) for r in got] == [(2, 1)]
    r = got[0]
    assert docs[1][1][r["start"] : r["end"]] == " ".join(fuzzy) and docs[0][1][r["other_start"] : r["other_end"]] == " ".join(passage) and r["identity"] > 0.95
    assert passages.repeated(df.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count()
    assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] and zlib.crc32(b"1") >= 0


def test_crowded_seeds_are_matched_in_their_block_and_beyond(spark):
    r = random.Random(8)
    own = lambda n: " ".join(f"f{r.randrange(10**9)}" for _ in range(n))
    shared = own(60)
    data = [(i, f"{own(r.randrange(30))} {shared} {own(r.randrange(30))}") for i in range(90)] + [(i, own(200)) for i in range(90, 120)]
    for parts in (1, 3, 45):  # crowded in a block, in some, in none
        got = passages.repeated(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
        assert {x.doc_id for x in got} == set(range(1, 90))
        assert all(dict(data)[x.doc_id][x.start : x.end] == dict(data)[x.other_id][x.other_start : x.other_end] == shared for x in got)
        assert len(got) < 3 * 90 * passages.FEW


def decided(data, got, least=50):
    """Whether every run of `least` words that an earlier document repeats lies in a reported passage."""
    held = {}
    for i, text in sorted(data):
        w = text.split()
        for k in range(len(w) - least + 1):
            held.setdefault(tuple(w[k : k + least]), i)
    missed = 0
    for i, text in data:
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        w = text.split()
        mine = [(r.start, r.end) for r in got if r.doc_id == i]
        for k in range(len(w) - least + 1):
            if held[tuple(w[k : k + least])] != i:
                missed += not any(s <= spans[k][0] and spans[k + least - 1][1] <= e for s, e in mine)
    return missed == 0


def test_passages_overlapping_other_shared_stretches(spark):
    r = random.Random(18)
    own = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    p = own(60)
    parts = {10: p, 20: p, 3: p[:33], 15: p[:33], 4: p[26:], 16: p[26:]}
    data = [(i, " ".join(own(40) + w + own(40))) for i, w in parts.items()]
    q = own(90)
    for i in range(30, 90):  # stretches of one passage, cut anywhere
        a = r.randrange(60)
        data.append((i, " ".join(own(20) + q[a : a + r.randrange(20, 70)] + own(20))))
    for n in (1, 7):
        got = passages.repeated(spark.createDataFrame(data, "doc_id long, text string").repartition(n)).collect()
        assert any((x.doc_id, x.other_id, x.n_words) == (20, 10, 60) for x in got)
        assert decided(data, got)


def test_chains_take_a_predecessor_within_the_gap():
    near = [(600 + 16 * k, 600 + 17 * k, 15) for k in range(4)]
    found = passages.chains_of(np.array([(0, 0, 500), *near]))
    assert [c.tolist() for c in found] == [[[0, 0, 500]], [list(a) for a in near]]


def test_stretches_against_all():
    a = np.arange(101)
    b = np.where((a >= 55) & (a < 79), a + 1000, a)
    got = passages.stretches(passages.aligned(np.array([(0, 0, 55), (79, 79, 22)]), a, b, 0, 0))
    assert got[0][:2] == (0, 55) or got[0][1] - got[0][0] >= 55
    # differences inside an anchor count
    assert passages.stretches(passages.aligned(np.array([(0, 0, 101)]), a, np.where(a % 3, a, a + 1000), 0, 0)) == []
    rng = random.Random(5)
    for _ in range(200):
        x = [k for k in range(160) if rng.random() < (0.95 if k // 40 % 2 else 0.6)]
        pairs = np.stack((x, x), axis=1)
        found = passages.stretches(pairs)
        assert all(x1 - x0 >= 50 and share >= 0.8 - 1e-9 and share == pytest.approx(sum(x0 <= v < x1 for v in x) / (x1 - x0)) for x0, x1, _, _, share in found)
        kept = set().union(*(range(f[0], f[1]) for f in found))
        for i in range(len(x)):
            for j in range(i, len(x)):
                if x[j] - x[i] >= 49 and j - i + 1 >= 0.8 * (x[j] - x[i] + 1) - 1e-9:
                    assert set(range(x[i], x[j] + 1)) <= kept

import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import arrays as A
from glyphlake.functions import text as T
from glyphlake.operators import aggregate, matching, payload, reading, sampling, segment, sequence

LINES = ["QZ바람개비9", "꿻뷁", "도서관", "책 목록 1999-12-01", "ㅂㅅㅈ ㅗㅜㅡ", "이름 : 달빛", "Grey Owl 7%", "값 b", ""]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_hangul_comes_apart(spark):
    got = spark.createDataFrame([(x,) for x in LINES], "t string").select("t", T.nfd_hangul(F.col("t")), T.nfd_any("t")).collect()
    for text, native, general in got:
        assert native == general == unicodedata.normalize("NFD", text)


def test_vocabulary(spark):
    vocab = F.create_map(F.lit("a"), F.lit(4), F.lit("b"), F.lit(5))
    assert one(spark, T.encode(F.col("t"), vocab), t="a★b") == [1, 4, 5, 2]
    tokens = F.array(*[F.lit(x) for x in ("<p>", "<b>", "<e>", "<u>", "a", "b")])
    assert one(spark, T.decode_ids(F.array(*[F.lit(i) for i in (1, 4, 5, 99, 2)]), tokens), t="") == "ab"


def test_kinds_and_spans(spark):
    got = spark.createDataFrame([("abc",), ("12",), ("가:나",), ("가나",), ("가나다라마바사 아",), ("",)], "t string").select(T.kind(F.col("t")), T.span(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("latin", "1-5"), ("digits", "1-5"), ("label", "1-5"), ("word", "1-5"), ("sentence", "6-10"), ("word", "1-5")]


def test_ratio_and_close(spark):
    pairs = [("도서관장", "도서곤장", True), ("푸른하늘목록표", "돌다리", False), ("", "", False), ("a", None, False)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select("a", "b", T.ratio("a", "b"), T.close(F.col("a"), F.col("b"))).collect()
    for (a, b, r, c), want in zip(got, pairs, strict=True):
        assert c == want[2]
        if b is not None:
            assert r == pytest.approx(SequenceMatcher(None, a, b).ratio())


def test_arrays(spark):
    v = F.array(*[F.lit(float(x)) for x in (1, 2, 3)])
    p = np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()
    assert one(spark, A.softmax(v), t="") == pytest.approx(p)
    assert one(spark, A.divergence(A.softmax(v), A.softmax(v)), t="") == pytest.approx(0)
    labels = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert one(spark, A.pad(labels, F.lit(5)), t="") == [1, 2, 3, -100, -100]
    assert one(spark, A.shift_right(A.pad(labels, F.lit(4)), 9, 0), t="") == [9, 1, 2, 3]
    assert one(spark, A.gamma_table(1.0), t="") == list(range(256))
    held = 5.0
    for k, x in enumerate((5.0, 1.0, 2.0)):
        r = min(0.9, (1 + k) / (10 + k))
        held = r * held + (1 - r) * x
    assert one(spark, A.moving_average(F.array(F.lit(5.0), F.lit(1.0), F.lit(2.0)), 0.9), t="") == pytest.approx(held)
    step = np.array(one(spark, A.norm_step(v, 0.5), t=""))
    assert np.linalg.norm(step) == pytest.approx(0.5)


def test_roll_is_pooled(spark):
    rows = spark.createDataFrame([("a", "abcd", "abcd"), ("a", "x", "yy"), ("b", "", "z")], "k string, read string, text string")
    got = {r["k"]: r for r in aggregate.roll_by(aggregate.marks(rows), [["k"], []]).collect()}
    assert got[None]["lines"] == 3 and got[None]["chars"] == 7
    assert got[None]["cer"] == pytest.approx(100 * 3 / 7, abs=1e-5)
    assert got["a"]["exact"] == 50.0


def test_quantile_ranks(spark):
    values = sorted(random.Random(1).sample(range(10**6), 173))
    got = {r["q"]: r["value"] for r in aggregate.ranked_quantiles(spark.createDataFrame([(1, v) for v in values], "k int, v long"), ["k"], "v").collect()}
    assert got == {q: values[min(172, int(173 * q))] for q in aggregate.QUANTILES}


def test_medoid(spark):
    reads = spark.createDataFrame([(1, 0, "가나다"), (1, 1, "가나다"), (1, 2, "가나라"), (2, 0, "x"), (3, 0, ""), (4, 0, "p"), (4, 1, "q")], "cell int, pos int, text string")
    got = {r["key"]: (r["text"], r["trust"]) for r in aggregate.medoid(reads, "cell", "pos", "text", T.ratio).collect()}
    assert got[1][0] == "가나다" and got[2] == ("x", 1.0) and 3 not in got and got[4] == ("p", 0.0)
    trusted = {r["cell"]: r for r in reading.trusted(reads, T.ratio).collect()}
    assert trusted[2]["trust"] == -1.0 and not trusted[2]["unsure"] and trusted[3]["text"] == ""


def test_greedy_pairs(spark):
    reads = spark.createDataFrame([(1, 0, "abc"), (1, 1, "xyz"), (1, 2, "abd")], "page int, pos int, text string")
    truths = spark.createDataFrame([(1, 0, "abd"), (1, 1, "abc"), (1, 2, "xyw"), (2, 0, "alone")], "page int, pos int, text string")
    got = {(r["page"], r["truth_pos"]): r["read"] for r in matching.greedy_pairs(reads, truths, "page").collect()}
    assert got == {(1, 0): "abd", (1, 1): "abc", (1, 2): "xyz", (2, 0): ""}


def test_islands_and_rows(spark):
    at = [0, 1, 2, 6, 7, 30]
    got = sorted((r["start"], r["end"], r["n"]) for r in sequence.islands(spark.createDataFrame([(1, a) for a in at], "k int, t long"), ["k"], "t", 3).collect())
    assert got == [(0, 2, 3), (6, 7, 2), (30, 30, 1)]
    boxes = spark.createDataFrame([(1, 0, 10), (2, 5, 12), (3, 12, 20), (4, 11, 30)], "id int, top int, bottom int").withColumn("k", F.lit(1))
    assert {r["id"]: r["row"] for r in sequence.overlap_rows(boxes, ["k"], "top", "bottom", "id").collect()} == {1: 0, 2: 0, 4: 0, 3: 0}


def test_payload(spark):
    values = ["aGk=", "data:text/plain;base64,aGk=", "https://example.com/a.jpg", "data:image/png,raw", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(payload.image_bytes(F.col("v"))).collect()]
    assert [bytes(g) if g is not None else None for g in got] == [b"hi", b"hi", None, None, None, None]
    content = '[{"type":"text","text":"x"},{"type":"image_url","image_url":{"url":"data:a"}},{"type":"image_url","image_url":"b"}]'
    assert one(spark, payload.image_urls(F.col("c")), c=content) == ["data:a", "b"]


def test_segments():
    page = np.full((200, 300), 255, np.uint8)
    page[20:40, 10:120] = 0
    page[20:40, 200:280] = 0
    page[80:100, 30:200] = 0
    assert segment.boxes(page) == [(10, 20, 120, 40), (200, 20, 280, 40), (30, 80, 200, 100)]
    assert segment.boxes(np.full((20, 20), 255, np.uint8)) == []


def test_streamed_sessions(spark, tmp_path):
    from glyphlake.streaming.sessions import sessions

    spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp'2024-01-01 00:00:10' UNION ALL SELECT 1, timestamp'2024-01-01 01:00:00'").write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts", "10 seconds", "1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("SELECT n FROM sessions_out").collect()) == [1, 2]


def test_sinks_replace_whole_tables(spark, tmp_path):
    from glyphlake.sources import files

    path = str(tmp_path / "t")
    files.atomic_write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    got = files.merge_into(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert not (tmp_path / "t-part").exists() and not (tmp_path / "t-old").exists()
    seen = []

    def measure(rows):
        seen.append(rows.count())
        return rows.withColumn("n", F.lit(1))

    planned = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "side string, v int")
    out = str(tmp_path / "c")
    files.checkpointed(planned.where("side = 'x'"), out + "-first", "side", measure)
    (tmp_path / "c-first").rename(tmp_path / "c-partial")
    assert files.checkpointed(planned, out, "side", measure).count() == 3 and seen == [2, 1]
    files.json_store(planned, str(tmp_path / "j"))
    assert files.json_card(spark, str(tmp_path / "j"), "side string, v int").count() == 3


def test_truth_file_and_members(spark, tmp_path):
    import io
    import json
    import zipfile

    from glyphlake.sources import files

    (tmp_path / "t.json").write_text(json.dumps({"p1": {"lines": ["가", "b"], "gauge": True}, "p2": {"lines": ["c"]}}), encoding="utf-8")
    got = sorted(map(tuple, files.truth(spark, str(tmp_path / "t.json")).collect()))
    assert got == [("p1", 0, "가", True), ("p1", 1, "b", True), ("p2", 0, "c", False)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for n in ("a/x.TTF", "a/._x.ttf", "y.txt"):
            z.writestr(n, n)
    rows = files.zip_members(spark.createDataFrame([("z", bytearray(data.getvalue()))], "path string, content binary"), [".ttf"]).collect()
    assert [(r["name"], bytes(r["content"])) for r in rows] == [("a/x.TTF", b"a/x.TTF")]
    for n in ("b.jpg", "a.jpg", "c.png"):
        (tmp_path / n).write_bytes(b"\x89PNG" if n == "c.png" else b"\xff\xd8\xff")
    pics = files.images(spark, str(tmp_path)).select("path", payload.image_kind(F.col("content"))).collect()
    assert [(r[0].split("/")[-1], r[1]) for r in pics] == [("a.jpg", "jpeg"), ("b.jpg", "jpeg")]


def test_routes(spark):
    asks = [("GET", "/v1/models", None, 0), ("GET", "/nope", None, 0), ("POST", "/read", "hi", 9), ("POST", "/v1/chat/completions", "", 0), ("POST", "/api/generate", "", 0), ("POST", "/read", "x", payload.BODY + 1), ("PUT", "/read", "x", 1)]
    got = payload.routed(spark.createDataFrame(asks, "method string, path string, text string, bytes long"), "m").collect()
    assert [r["status"] for r in got] == [200, 404, 200, 400, 200, 413, 404]
    assert '"id":"m"' in got[0]["body"] and got[2]["body"] == '{"text":"hi"}' and "invalid_request_error" in got[3]["body"] and '"load"' in got[4]["body"]


def test_ranks_hold_hot_values_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.choice([1.0, 5.0, rng.random() * 9])) for _ in range(5000)] + [("b", 2.0), ("a", None)]
    got = aggregate.ranked_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    for k in ("a", "b", None):
        values = sorted(v for key, v in rows if key == k and v is not None)
        mine = {r["q"]: r["value"] for r in got if r["k"] == k}
        assert mine == {q: values[min(len(values) - 1, int(len(values) * q))] for q in aggregate.QUANTILES}
    assert aggregate.ranked_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v").collect() == []


def test_scores_of_reads(spark):
    from glyphlake.operators import scoring

    reads = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (1, 9, "c"), (2, 1, None)], "k int, at int, text string")
    truths = spark.createDataFrame([(1, 1, "a"), (1, 2, "x"), (2, 1, ""), (3, 1, "z")], "k int, at int, text string")
    pairs = scoring.zipped(reads, truths, ["k"], "at", "text")
    assert sorted((r.k, r.pos, r.read or "", r.truth) for r in pairs.collect()) == [(1, 0, "a", "a"), (1, 1, "b", "x"), (2, 0, "", "")]
    told = {r.k: (r.lines, r.letters, r.hits, r.letter_rate, r.line_rate) for r in scoring.hit_rates(pairs, ["k"]).collect()}
    assert told == {1: (2, 2, 1, 0.5, 0.5), 2: (1, 0, 0, 0.0, 1.0)}
    lines = [("p", 90.0, 0.9, False), ("p", 100.0, 0.5, False), ("q", 95.0, -1.0, None), ("g", 10.0, 0.1, True)]
    card = scoring.photo_card(spark.createDataFrame([("x", *r) for r in lines], "k string, photo string, score double, trust double, gauge boolean"), ["k"], "photo", "score", "trust", "gauge").first()
    assert card.asDict() == {"k": "x", "photos": 2, "mean": 95.0, "low": 95.0, "reached": 2, "worst": "p", "unsure": 1, "gated": 70.0, "gauge_photos": 1, "gauge_mean": 10.0}
    boxes = spark.createDataFrame([(1, 0, 30), (1, 1, 10), (1, 2, 5), (1, 3, 10)], "k int, cut int, top int")
    assert sorted((r.cut, r.place) for r in scoring.first_lines(boxes, ["k"], "cut", "top", 2).collect()) == [(0, 1), (1, 0)]
    assert scoring.hit_rates(pairs.limit(0), ["k"]).count() == 0

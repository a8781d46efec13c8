"""Running states over restarts, snapshots, checked writes, pictures as bytes, pairing in rounds, replies, summaries."""

import json
import random
import struct
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import text as T
from glyphlake.operators import aggregate, matching, payload, reading, segment
from glyphlake.sources import pictures, snapshots
from glyphlake.streaming import running


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice((1, 2, 3, None)), i, r.choice((None, float("nan"), r.random(), r.random(), r.random()))) for i in range(90)]
    kind = "k int, at int, v double"
    source = tmp_path / "in"

    def run():
        stream = running.running(spark.readStream.schema(kind).parquet(str(source)), "k", ["at"], "v")
        put = lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", running.PROVIDER)
    try:
        # each part comes to a stream of its own that starts from the checkpoint
        for part in (rows[:30], rows[30:31], rows[31:]):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(source))
            run()
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.parquet(str(tmp_path / "out"))
    last = told.groupBy("key").agg(F.max_by(F.struct("seen", "k", "held", "best", "misses"), "n").alias("s")).select("key", "s.*")
    rounded = lambda df: sorted((str(tuple(round(x, 9) if isinstance(x, float) else x for x in row)) for row in df.collect()))
    assert rounded(last) == rounded(running.folded(spark.createDataFrame(rows, kind), "k", ["at"], "v"))
    plain = {}
    for k, _, v in rows:
        plain[k] = running.step(plain.get(k, (0, 0, None, None, 0)), v, 0.9)
    assert {x["key"]: (x["seen"], x["misses"]) for x in last.collect()} == {k: (s[0], s[4]) for k, s in plain.items()}


def test_snapshots_are_kept_and_read_as_of(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(LookupError):
        snapshots.as_of(spark, log)
    for v in range(1, 8):
        snapshots.commit(spark.range(v), log, v, keep=2, every=3)
    assert snapshots.versions(spark, log) == [3, 6, 7]
    assert snapshots.as_of(spark, log).count() == 7 and snapshots.as_of(spark, log, 5).count() == 3
    snapshots.commit(spark.range(70), log, 7, keep=2, every=3)
    assert snapshots.as_of(spark, log, 7).count() == 70 and snapshots.versions(spark, log) == [3, 6, 7]
    with pytest.raises(LookupError):
        snapshots.as_of(spark, log, 2)


def test_micro_batches_become_snapshots(spark, tmp_path):
    log = str(tmp_path / "log")
    put = snapshots.sink(log, keep=2, whole=lambda last, batch: batch if last is None else matching.upsert(last, batch, ["k"]))
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c")], [(3, "d")])):
        put(spark.createDataFrame(rows, "k int, v string"), n)
    # the last batch again, as after a lost driver
    put(spark.createDataFrame([(3, "d")], "k int, v string"), 2)
    assert sorted(map(tuple, snapshots.as_of(spark, log).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert snapshots.versions(spark, log) == [1, 2]


def test_a_refused_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rules = {"positive": F.col("id") >= 0, "named": F.col("name").isNotNull()}
    snapshots.checked_write(spark.createDataFrame([(1, "a")], "id int, name string"), path, rules)
    for bad, least in (([(2, "b"), (-1, None), (None, "x")], 0), ([(2, "b")], 5)):
        with pytest.raises(snapshots.Refused) as e:
            snapshots.checked_write(spark.createDataFrame(bad, "id int, name string"), path, rules, least=least)
        assert ("'positive': 2" in str(e.value) and "'named': 1" in str(e.value)) or "'rows': 1" in str(e.value)
        assert [tuple(x) for x in spark.read.parquet(path).collect()] == [(1, "a")] and not (tmp_path / "t-part").exists()


def plain_png(rows, width, depth, colour, kinds, palette=None):
    """A PNG with the given filter for each row, by the format's own formulas."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=False):
        line = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) & 255)
        out += bytes([kind]) + bytes(line)
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)[:9]) + chunk(b"IDAT", zlib.compress(out)[9:]) + chunk(b"IEND", b"")


def test_png_of_every_filter_and_colour():
    r = np.random.default_rng(4)
    kinds = (0, 1, 2, 3, 4, 4, 3, 1)
    for colour, channels in pictures.CHANNELS.items():
        if colour == 3:
            continue
        pix = r.integers(0, 256, (8, 11, channels), dtype=np.uint8)
        got = pictures.decoded(plain_png([row.tobytes() for row in pix], 11, 8, colour, kinds))
        want = pix[:, :, 0] if channels < 3 else (pix[:, :, :3].astype(int) @ [299, 587, 114] // 1000).astype(np.uint8)
        assert (got == want).all()
    for depth in (1, 2, 4, 8):
        codes = r.integers(0, 1 << depth, (8, 13))
        packed = [np.packbits(np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 8 - depth :].reshape(-1)).tobytes() for row in codes]
        palette = r.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        got = pictures.decoded(plain_png(packed, 13, depth, 3, kinds, palette.tobytes()))
        assert (got == (palette[codes].astype(int) @ [299, 587, 114] // 1000)).all()
        assert (pictures.decoded(plain_png(packed, 13, depth, 0, kinds)) == codes * (255 // ((1 << depth) - 1))).all()


def test_pictures_round_trip_and_faults(spark):
    r = np.random.default_rng(5)
    rows = [(i, *s, r.integers(0, 256, s, dtype=np.uint8).tobytes()) for i, s in enumerate(((1, 1), (3, 70), (70, 3), (40, 40)))]
    pages = spark.createDataFrame(rows, "page int, h int, w int, pix binary")
    got = {x["page"]: (x["h"], x["w"], bytes(x["pix"])) for x in pictures.read(pictures.write(pages)).collect()}
    assert got == {p: (h, w, pix) for p, h, w, pix in rows}
    good = pictures.encoded(np.zeros((4, 4), np.uint8))
    bad = [(0, None), (1, b""), (2, b"\xff\xd8\xff\xd9"), (3, good[:40]), (4, good[:-20]), (5, good.replace(b"IDAT", b"IDAX"))]
    out = pictures.read(spark.createDataFrame(bad, "page int, content binary")).collect()
    assert len(out) == 6 and all(x["pix"] is None and x["fault"] for x in out)


def test_turns_of_both_formats():
    page = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    for turn, upright in want.items():
        assert pictures.turn_of(pictures.encoded(page, turn)) == turn
        assert pictures.UPRIGHT[turn](page).tolist() == upright
        exif = struct.pack(">2sHIHHHIHHHHIHH", b"MM", 42, 8, 2, 0x010F, 2, 1, 65, 0, 0x0112, 3, 1, turn, 0)
        jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + b"\xff\xd9"
        assert pictures.turn_of(jpeg) == turn
    assert [pictures.turn_of(x) for x in (b"", b"\xff\xd8\xff\xe1\0", b"GIF89a", pictures.encoded(page))] == [1] * 4


def plain_pairs(got, want):
    taken, chosen = set(), {}
    for s, i, j in sorted(((SequenceMatcher(None, g, w).ratio(), i, j) for j, w in enumerate(want) for i, g in enumerate(got)), reverse=True):
        if i not in taken and j not in chosen:
            chosen[j] = (i, s)
            taken.add(i)
    return chosen


def test_rounds_pair_as_the_sorted_list_does(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(0, 5)))
    keys = {k: ([word() for _ in range(r.randrange(0, 9))], [word() for _ in range(r.randrange(0, 9))]) for k in range(12)}
    # a key of many equal lines
    keys[50] = (["same"] * 25 + ["other"], ["same"] * 20)
    side = lambda n: spark.createDataFrame([(k, p, t) for k, v in keys.items() for p, t in enumerate(v[n])], "k int, pos int, text string").repartition(5)
    got = {}
    for x in matching.greedy_pairs(side(0), side(1), "k").collect():
        got.setdefault(x["k"], {})[x["truth_pos"]] = None if x["read_pos"] is None else (x["read_pos"], x["score"])
    assert got == {k: {j: plain_pairs(*v).get(j) for j in range(len(v[1]))} for k, v in keys.items() if v[1]}


def test_streamed_reply_is_lines_of_json(spark):
    out = payload.ndjson(spark.createDataFrame([(1, 'say "hi"\n가'), (2, ""), (3, None)], "k int, text string"), ["k"], "m").orderBy("k", "n").collect()
    assert [(x["k"], x["n"], json.loads(x["line"])["done"]) for x in out] == [(1, 0, False), (1, 1, True), (2, 0, True), (3, 0, True)]
    assert json.loads(out[0]["line"])["message"]["content"] == 'say "hi"\n가' and all(x["line"].count("\n") == 1 for x in out)


def test_summary_and_tight_ratio(spark):
    rows = [("r", f"f{i:02d}", float(i)) for i in range(25)] + [("r", "none", None), ("s", "b", 1.0), ("s", "a", 1.0)]
    got = {x["run"]: x for x in aggregate.summary(spark.createDataFrame(rows, "run string, name string, score double"), ["run"], "name", "score", 3).collect()}
    assert (got["r"]["n"], got["r"]["lowest"], got["r"]["tenth"], got["r"]["middle"]) == (25, 0.0, 2.0, 12.0)
    assert [x["name"] for x in got["r"]["worst"]] == ["f00", "f01", "f02"] and [x["name"] for x in got["s"]["worst"]] == ["a", "b"]
    one = spark.createDataFrame([("성명 : 홍", "성명: 홍")], "a string, b string").select(T.ratio_tight(F.col("a"), F.col("b")).alias("t"), T.ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert one["t"] == 1.0 and one["r"] < 1.0


def test_nearly_empty_cells_are_thickened_or_left_out():
    cell = np.full((20, 200), 255, np.uint8)
    assert segment.inked_enough(cell) is None
    cell[5, 5:9] = 0
    thick = segment.inked_enough(cell)
    assert thick is not None and (thick < segment.INK).sum() > 4
    cell[:, ::4] = 0
    assert segment.inked_enough(cell) is cell


def test_photos_that_cannot_be_read_have_the_empty_text(spark):
    blank = pictures.encoded(np.full((60, 60), 255, np.uint8))
    files = spark.createDataFrame([(1, None), (2, b"x"), (3, blank)], "page long, content binary")
    assert sorted(map(tuple, reading.photographed(files, lambda x: ["?"] * len(x)).collect())) == [(1, ""), (2, ""), (3, "")]

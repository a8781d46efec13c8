"""Archives as a data source."""

import io
import os
import zipfile

import pytest

from glyphlake.operators import payload
from glyphlake.sources import archives


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    archives.register(spark)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def read(spark, path, **options):
    return spark.read.format("members").options(**options).load(str(path))


def write(rows, path, mode="overwrite"):
    rows.write.format("members").mode(mode).save(str(path))


@pytest.mark.parametrize("split", [300, 5000, 1 << 26])
def test_each_member_once_whatever_the_stretch(spark, tmp_path, split):
    members = [(f"f/{k}.ttf", os.urandom(k * 37 % 900)) for k in range(60)]
    (tmp_path / "one.zip").write_bytes(zipped(members))
    got = read(spark, tmp_path, split=split).select("name", "size", "content").collect()
    assert sorted((r.name, r.size, bytes(r.content)) for r in got) == sorted((n, len(c), c) for n, c in members)


def test_large_archive_goes_to_several_tasks(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(zipped([(f"{k}", os.urandom(1000)) for k in range(50)]))
    frame = read(spark, tmp_path, split=10_000)
    assert frame.rdd.getNumPartitions() == 6
    assert frame.select("name").distinct().count() == 50


def test_suffixes_forks_folders_and_twins(spark, tmp_path):
    with pytest.warns(UserWarning):
        body = zipped([("a/x.TTF", b"1"), ("a/._x.ttf", b"2"), ("a/", b""), ("y.otf", b""), ("z.txt", b"3"), ("a/x.TTF", b"4")])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.zip").write_bytes(body)
    (tmp_path / "note.txt").write_text("not an archive")
    got = read(spark, tmp_path, suffixes=".ttf, .otf").select("name", "content").collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == [("a/x.TTF", b"1"), ("a/x.TTF", b"4"), ("y.otf", b"")]


def test_broken_archive_is_noted_or_raises(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive" * 50)
    (tmp_path / "good.zip").write_bytes(zipped([("a", b"1")]))
    got = read(spark, tmp_path, broken="note", split=100).orderBy("path").collect()
    assert [(r.name, r.size) for r in got] == [(None, None), ("a", 1)]
    with pytest.raises(Exception, match="not a zip file"):
        read(spark, tmp_path).collect()


def test_empty_folder_and_wrong_options(spark, tmp_path):
    assert read(spark, tmp_path).count() == 0
    for wrong in ({"broken": "skip"}, {"split": 0}):
        with pytest.raises(Exception, match="broken|split"):
            read(spark, tmp_path, **wrong).collect()


def test_round_trip_append_overwrite_and_empty(spark, tmp_path):
    at = tmp_path / "out"
    frame = lambda rows: spark.createDataFrame(rows, "name string, content binary")
    names = lambda: sorted(r.name for r in read(spark, at).collect())
    write(frame([(f"{k}", b"x" * k) for k in range(20)]).repartition(4), at)
    got = {r.name: bytes(r.content) for r in read(spark, at).collect()}
    assert got == {f"{k}": b"x" * k for k in range(20)}
    write(frame([("more", None)]), at, "append")
    assert names() == sorted([*got, "more"])
    write(frame([("only", b"1")]), at)
    assert names() == ["only"]
    assert len(list(at.glob("*.zip"))) == 1
    write(frame([]), at)
    assert names() == []


def test_failed_write_leaves_the_old_members(spark, tmp_path):
    at = tmp_path / "out"
    write(spark.createDataFrame([("a", b"1")], "name string, content binary"), at)
    with pytest.raises(Exception, match="without a name"):
        write(spark.createDataFrame([("b", b"1"), (None, b"2")], "name string, content binary").repartition(2), at)
    assert [r.name for r in read(spark, at).collect()] == ["a"]
    with pytest.raises(Exception, match="needs name and content"):
        write(spark.createDataFrame([("b", b"1", 1)], "name string, content binary, more int"), at, "append")
    # what a lost attempt leaves isn't listed
    (at / "part-lost.zip").write_bytes(zipped([("lost", b"1")]))
    assert [r.name for r in read(spark, at).collect()] == ["a"]


def test_event_stream(spark):
    frame = spark.createDataFrame([('say "가"',), ("",), (None,)], "t string")
    got = [r[0] for r in frame.select(payload.event_stream(frame.t, "m")).collect()]
    assert all(g.endswith("data: [DONE]\n\n") and g.count("data: ") == 3 for g in got)
    assert '"content":"say \\"가\\""' in got[0] and got[1] == got[2]


def test_a_task_begins_another_archive(spark, tmp_path, monkeypatch):
    from glyphlake.sources import archives

    monkeypatch.setattr(archives, "MEMBERS", 4)
    writer = archives.MembersWriter({"path": f"{tmp_path}/a"}, spark.createDataFrame([], "name string, content binary").schema, True)
    done = writer.write(iter([{"name": f"m{k}", "content": b"x"} for k in range(9)]))
    writer.commit([done, None, archives.Written([])])
    archives.register(spark)
    rows = spark.read.format("members").load(f"{tmp_path}/a").collect()
    assert len(done.names) == 3 and sorted(r.name for r in rows) == [f"m{k}" for k in range(9)] and len({r.path for r in rows}) == 3

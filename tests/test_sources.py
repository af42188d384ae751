import bz2
import json
import os
import struct
import tarfile

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from lakewalk import schema
from lakewalk.operators import filters
from lakewalk.sources import archives, caches, synthetic, walk
from lakewalk.streaming import profile as streaming


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "a/b").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / "a/f.txt").write_text("hello")
    (root / "a/b/ü |x").write_bytes(b"\0\0")
    (root / ".hidden").write_text("")
    os.symlink("a/f.txt", root / "link")
    os.symlink("nowhere", root / "dangling")
    os.mkfifo(root / "pipe")
    return str(root)


def found(df, root):
    return {r["path"][len(root) :] or "/": r for r in df.collect()}


def test_walk(spark, tree):
    for split in ("0", "1", "2", "9"):
        got = found(walk.walk(spark, tree, split=split), tree)
        assert {p: r["type"] for p, r in got.items()} == {
            "/": 3,
            "/a": 3,
            "/a/b": 3,
            "/empty": 3,
            "/a/f.txt": 2,
            "/a/b/ü |x": 2,
            "/.hidden": 2,
            "/link": 4,
            "/dangling": 4,
            "/pipe": 1,
        }
    assert got["/a/f.txt"]["size"] == 5 and got["/link"]["link_target"] == "a/f.txt" and got["/a"]["depth"] == tree.count("/") + 1
    st = os.lstat(tree + "/a/f.txt")
    assert got["/a/f.txt"]["mtime"] * 10**9 + got["/a/f.txt"]["mtime_nsec"] == st.st_mtime_ns and got["/a/f.txt"]["ino"] == st.st_ino


def test_walk_options(spark, tree):
    lite = walk.walk(spark, tree, lite="true")
    assert lite.columns == ["path", "depth", "type"] and lite.count() == 10
    assert {p: r["type"] for p, r in found(lite, tree).items()}["/link"] == 4
    followed = found(walk.walk(spark, tree, dereference="true"), tree)
    assert followed["/link"]["type"] == 2 and "/dangling" not in followed
    kept = found(walk.walk(spark, tree, dereference="true", errors="keep"), tree)
    assert kept["/dangling"]["error"] == "missing" and kept["/dangling"]["mode"] is None
    assert found(
        walk.walk(spark, tree, digest="true"), tree
    )["/a/f.txt"]["digest"] == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert walk.walk(spark, tree, tree + "/a").count() == 14
    again = walk.restat(
        walk.walk(spark, tree, lite="true").unionByName(spark.createDataFrame([("/none", 1, 2)], schema.LITE))
    )
    assert again.count() == 10 and found(again, tree)["/a/f.txt"]["size"] == 5
    one = walk.explicit(spark, [{"path": "/x/y"}]).first()
    assert (one["depth"], one["type"], one["size"]) == (2, 1, None)


def test_walk_of_a_flat_directory(spark, tmp_path):
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3000):
        (flat / f"f{i}").touch()
    df = walk.walk(spark, str(flat))
    assert df.rdd.getNumPartitions() == 1 and df.count() == 3001
    assert len(walk.TreeReader(schema.LITE, {"path": str(flat), "lite": "true"}).partitions()) == 1
    assert walk.walk_levels(spark, str(flat), stats=False).count() == 3001


def test_directories_that_cannot_be_listed(spark, tree, monkeypatch):
    from lakewalk.plans import sync

    scandir = os.scandir

    def refusing(path):
        if str(path).endswith("/a"):
            raise PermissionError(path)
        return scandir(path)

    monkeypatch.setattr(os, "scandir", refusing)
    names = [*schema.EXTENDED.names, "digest", "error"]
    for split in ("0", "1", "2"):
        reader = walk.TreeReader(walk.TreeSource({}).schema(), {"path": tree, "split": split})
        found = [dict(zip(names, r)) for part in reader.partitions() for r in reader._walk(part)]
        assert {f["path"][len(tree) :]: f["error"] for f in found} == {"": None, "/a": "unlistable", "/empty": None, "/.hidden": None, "/link": None, "/dangling": None, "/pipe": None}
    monkeypatch.undo()
    src = walk.walk(spark, tree)
    assert sync.check(src, delete=True)
    assert not sync.check(src.withColumn("error", F.when(F.col("path").endswith("/a"), "unlistable")), delete=True)


def test_followed_links_do_not_go_round(spark, tree):
    os.symlink("..", tree + "/a/up")
    got = [r["path"][len(tree) :] for r in walk.walk(spark, tree, dereference="true").collect()]
    assert "/a/up" in got and len(got) < 60


def test_walk_by_levels_is_the_walk(spark, tree):
    columns = ["path", "type", "size", "mtime", "link_target", "error"]
    assert rows(walk.walk_levels(spark, tree, tree + "/a/b"), *columns) == sorted({*rows(walk.walk(spark, tree), *columns)}, key=repr)


def test_text_cache(spark, tmp_path):
    df = spark.createDataFrame([("/a|b", 1, 2), ("/c", 1, 3), ("/d e", 1, 4), ("/f", 1, 1)], schema.LITE)
    caches.write_text_cache(df, f"{tmp_path}/t")
    assert rows(caches.read_text_cache(spark, f"{tmp_path}/t")) == rows(df)
    (tmp_path / "odd").write_text("/x\n/y|Z\n")
    assert rows(caches.read_text_cache(spark, f"{tmp_path}/odd"), "path", "type") == [("/x", 1), ("/y", 1)]


def test_binary_cache(spark, tree, tmp_path):
    df = walk.walk(spark, tree)
    for version in (3, 4):
        at = f"{tmp_path}/v{version}"
        assert caches.write_binary_cache(df, at, [(0, "root"), (1, "bin")], [(0, "wheel")], version) == 10
        names = schema.INVENTORY.names
        assert rows(caches.read_binary_cache(spark, at)) == rows(df.select(*names))
        one = sorted(f for f in os.listdir(at) if f.endswith(".cache"))[0]
        assert caches.cache_names(f"{at}/{one}") == ([(0, "root"), (1, "bin")], [(0, "wheel")])
    assert caches.write_binary_cache(df.limit(0), f"{tmp_path}/none") == 0
    assert caches.read_binary_cache(spark, f"{tmp_path}/none").count() == 0


def test_binary_cache_rewritten_in_place(spark, tmp_path, monkeypatch):
    made = lambda n: walk.explicit(spark, [{"path": f"/{i}", "size": i} for i in range(n)]).repartition(3)
    at = f"{tmp_path}/cache"
    assert caches.write_binary_cache(made(1000), at) == 1000
    assert caches.write_binary_cache(made(10), at) == 10
    assert rows(caches.read_binary_cache(spark, at), "path", "size") == sorted(((f"/{i}", i) for i in range(10)), key=repr)
    # A writer that dies before its manifest leaves readers the old cache.
    monkeypatch.setattr(caches.Files, "replace_text", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        caches.write_binary_cache(made(500), at)
    monkeypatch.undo()
    assert caches.read_binary_cache(spark, at).count() == 10
    assert caches.write_binary_cache(made(20), at) == 20 and caches.read_binary_cache(spark, at).count() == 20
    assert len([f for f in os.listdir(at) if f.endswith(".cache")]) <= 3


def test_binary_cache_layout(spark, tmp_path):
    row = spark.createDataFrame([("/a", 0o100644, 1, 2, 3, 4, 5, 6, 7, 8, 9)], ["path", *caches.NUMBERS]).toArrow()
    data = caches.encode_head(1, [(1, "me")], [], 8) + caches.encode_batch(row.to_batches()[0], 8)
    assert struct.unpack(">7Q", data[:56]) == (4, 1, 3, 0, 0, 1, 8)
    assert data[56:67] == b"me\0" + struct.pack(">Q", 1)
    assert data[67:75] == b"/a" + b"\0" * 6 and struct.unpack(">10Q", data[75:]) == (0o100644, *range(1, 10))
    (tmp_path / "one.lst").write_bytes(data)
    assert rows(
        caches.read_binary_cache(spark, f"{tmp_path}/one.lst"), "path", "type", "size", "ctime_nsec"
    ) == [("/a", 2, 9, 8)]


def test_reports(spark):
    df = spark.createDataFrame(
        [("/t,\"x", 10, 5, 0.5, 1, 1, 2, 3, 4, 5)],
        "directory string, total bigint, cold bigint, ratio double, errors bigint, day1 bigint, day30 bigint, day90 bigint, day180 bigint, day365 bigint",
    )
    assert caches.csv_report(df).first()[:4] == ('/t,"x', "10.000000", "5.000000", "0.5000000000")
    text = walk.explicit(
        spark, [{"path": "/p", "type": 2, "mode": 0o100644, "size": 1536, "mtime": 0}, {"path": "/q", "type": 3}]
    ).withColumn("user", F.lit("u")).withColumn("group", F.lit("g"))
    assert rows(caches.listing(text)) == [("-rw-r--r-- u g   1.500 KiB Jan  1 1970 00:00 /p",), ("Type=DIR File=/q",)]


def test_json_report(spark):
    from lakewalk.operators import profile

    df = walk.explicit(
        spark, [{"path": "/p", "type": 2, "mode": 0o100644, "size": 5, "atime": 1, "mtime": 1, "ctime": 1}]
    )
    now = 4000 * 86400
    value = caches.json_report(
        profile.type_counts(df, now),
        profile.file_size_profile(df),
        profile.age_profile(df, now),
        filters.broken_sample(df, now, 9),
        now,
    ).first()[0]
    report = json.loads(value)
    assert report["summary"]["files"] == 1 and len(report["size_histogram"]) == 10 and len(report["age_histograms"]) == 27 and report["broken_paths"] == [
        {"path": "/p", "flags": 2}
    ]


def test_archives(spark, tree, tmp_path):
    for name, mode in (("x.tar", "w"), ("y.tar.gz", "w:gz")):
        with tarfile.open(tmp_path / name, mode) as tar:
            tar.add(tree + "/a", "a")
            tar.add(tree + "/link", "link")
    listed = archives.archive_list(
        spark.createDataFrame([(f"{tmp_path}/x.tar",), (f"{tmp_path}/y.tar.gz",), (None,)], "archive string")
    )
    assert rows(listed.filter("archive like '%.tar'"), "path", "type", "size") == [
        ("a", 3, 0), ("a/b", 3, 0), ("a/b/ü |x", 2, 2), ("a/f.txt", 2, 5), ("link", 4, 0)
    ]
    assert listed.count() == 10
    (tmp_path / "l.bz2").write_bytes(bz2.compress(b"one\ntwo\n"))
    assert rows(archives.compressed_lines(spark, f"{tmp_path}/l.bz2")) == [("one",), ("two",)]
    archives.write_compressed(archives.compressed_lines(spark, f"{tmp_path}/l.bz2"), f"{tmp_path}/out")
    assert rows(spark.read.text(f"{tmp_path}/out")) == [("one",), ("two",)]


def test_archives_and_their_index(spark, tmp_path):
    data = [("a/f", 2, b"hello" * 300, None), ("a/empty", 2, b"", None), ("a/null", 2, None, None), ("a", 3, None, None), ("l", 4, None, "x"), ("pipe", 1, None, None), (None, 2, b"x", None), ("n" * 300, 2, b"long", None)]
    df = spark.createDataFrame(data, "path string, type int, content binary, link_target string").selectExpr("*", "CAST(NULL AS INT) AS mode", "CAST(NULL AS BIGINT) AS uid", "7L AS gid", "5L AS mtime")
    index = archives.write_archives(df.repartition(2), f"file://{tmp_path}/out")
    assert rows(index, "path", "type", "size", "gid") == sorted([("a/f", 2, 1500, 7), ("a/empty", 2, 0, 7), ("a/null", 2, 0, 7), ("a", 3, 0, 7), ("l", 4, 0, 7), ("n" * 300, 2, 4, 7)], key=repr)
    assert {r["path"]: bytes(r["content"]) for r in archives.indexed_contents(index).collect()} == {"a/f": b"hello" * 300, "a/empty": b"", "a/null": b"", "n" * 300: b"long"}
    scanned = archives.archive_list(index.select("archive").distinct())
    assert rows(scanned, "path", "data_offset") == rows(index, "path", "data_offset")
    assert archives.write_archives(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_synthetic(spark):
    one, two = synthetic.tree(spark, 500, seed=4), synthetic.tree(spark.newSession(), 500, seed=4).repartition(3)
    assert rows(one) == rows(two) and rows(one) != rows(synthetic.tree(spark, 500, seed=5))
    assert one.groupBy("type").count().count() == 3 and one.filter("size >= 1048576 OR size < 0").count() == 0
    small = one.withColumn("size", F.col("size") % 200)
    for pattern in ("random", "true", "false", "alternate"):
        made = synthetic.fill(small, pattern)
        assert made.filter("type = 2 AND octet_length(content) <> size").count() == 0
    assert synthetic.fill(small, "alternate").filter("type = 2 AND size > 2").first()["content"][:3] == b"\xff\x00\xff"


def test_streams(spark, tmp_path):
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    first = walk.explicit(spark, [{"path": "/a", "type": 2, "size": 5}, {"path": "/b", "type": 3}])
    first.coalesce(1).write.parquet(folder)

    def run():
        return rows(streaming.run_complete(streaming.type_profile(streaming.arriving(spark, folder)), root))

    assert run() == [(2, 1, 5), (3, 1, 0)]
    assert run() == [(2, 1, 5), (3, 1, 0)]
    walk.explicit(spark, [{"path": "/c", "type": 2, "size": 7}]).coalesce(1).write.mode("append").parquet(folder)
    assert run() == [(2, 2, 12), (3, 1, 0)]


def test_windows_are_put_out_once(spark, tmp_path):
    hour = 3600
    add = lambda *hours: spark.createDataFrame([(h * hour,) for h in hours], "t bigint").select(F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: rows(streaming.run_final(streaming.windows(streaming.arriving(spark, f"{tmp_path}/in"), "ts", [], "2 hours", "1 hour", "1 hour"), f"{tmp_path}/w"))
    add(100, 100, 101)
    assert run() == []
    add(104)
    assert run() == [(99 * hour, 2), (100 * hour, 3), (101 * hour, 1)]
    add(99)
    assert run() == [(99 * hour, 2), (100 * hour, 3), (101 * hour, 1)]
    add(110)
    assert run() == [(99 * hour, 2), (100 * hour, 3), (101 * hour, 1), (103 * hour, 1), (104 * hour, 1)]
    spark.createDataFrame([(0,), (50,), (200,)], "t bigint").select(F.timestamp_seconds("t").alias("ts"), F.lit("a").alias("k")).write.parquet(f"{tmp_path}/s")
    got = streaming.run_complete(streaming.sessions(streaming.arriving(spark, f"{tmp_path}/s"), "ts", ["k"], "60 seconds", "1 day"), f"{tmp_path}/t")
    assert rows(got) == [(0, 110, "a", 2), (200, 260, "a", 1)]


def test_late_and_repeated_deliveries(spark, tmp_path):
    start = 21600 * 80_000
    data = [(1, "a", start), (2, "a", start + 3600), (1, "a", start), (3, "b", start + 7 * 3600)]
    spark.createDataFrame(data, "id bigint, kind string, t bigint").select(
        "id", "kind", F.timestamp_seconds("t").alias("ts")
    ).write.parquet(f"{tmp_path}/in")
    stream = streaming.arriving(spark, f"{tmp_path}/in")
    got = streaming.run_complete(streaming.windows(stream, "ts", ["kind"], "6 hours", "1 day"), f"{tmp_path}/w")
    assert rows(got) == [(start, "a", 3), (start + 21600, "b", 1)]
    once = streaming.first_seen(
        stream, "id", "ts", "1 day"
    ).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 3


def test_spool(spark, tmp_path):
    walk.explicit(spark, [{"path": f"/{i}"} for i in range(40)]).select("path").write.parquet(f"{tmp_path}/in")
    at = streaming.spool(streaming.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/s", 4, "path")
    parts = [streaming.replayed(spark, at, k).count() for k in range(4)]
    assert sum(parts) == 40 and all(parts)
    assert "PartitionFilters: [isnotnull(batch_id" in streaming.replayed(spark, at, 1)._jdf.queryExecution().executedPlan().toString()

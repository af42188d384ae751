import random

import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from lakewalk import schema
from lakewalk.operators import chunks, compare, dedup, filters, order, predicates, profile
from lakewalk.plans import changes, sync
from lakewalk.sources.walk import explicit

DAY = 86400
NOW = 2_000_000_000


def entry(path, type=2, size=10, mode=None, **more):
    bits = {1: 0o010000, 2: 0o100644, 3: 0o040755, 4: 0o120777}[type] if mode is None else mode
    base = dict(
        path=path,
        type=type,
        size=size,
        mode=bits,
        uid=1,
        gid=2,
        atime=NOW,
        atime_nsec=0,
        mtime=NOW,
        mtime_nsec=0,
        ctime=NOW,
        ctime_nsec=0,
        dev=1,
        ino=None,
    )
    return base | more


@pytest.fixture(scope="module")
def empty(spark):
    return explicit(spark, [])


def paths_of(df):
    return sorted(r["path"] for r in df.collect())


def test_predicates(spark):
    df = explicit(
        spark,
        [
            entry("/a/.x", size=4096),
            entry("/a/b.txt", size=4097, atime=NOW - 60),
            entry("/a/d", 3, mtime=NOW + 5),
            entry("/a/l", 4, size=None),
            entry("/a/f", 1, mtime=NOW - 2 * DAY, mtime_nsec=1),
            entry("/a/null", mode=None) | {"mode": None, "atime": None, "size": None},
        ],
    )
    find = lambda *p: paths_of(predicates.find(df, *p))
    assert find(
        predicates.of_type("f")
    ) == ["/a/.x", "/a/b.txt"] and find(predicates.of_type("p")) == ["/a/f"] and find(predicates.of_type("b")) == []
    assert find(predicates.name("*x*")) == ["/a/b.txt"] and find(predicates.path("/a/*x*")) == ["/a/.x", "/a/b.txt"]
    assert find(predicates.size("+4k")) == ["/a/b.txt"] and find(predicates.size("4k")) == ["/a/.x"]
    assert find(predicates.age("atime", "1", (NOW, 0), 60)) == ["/a/b.txt"]
    assert find(predicates.age("mtime", "0", (NOW, 0), DAY)) == ["/a/.x", "/a/b.txt", "/a/d", "/a/l", "/a/null"]
    assert find(predicates.age("mtime", "1", (NOW, 0), DAY)) == ["/a/f"]  # a nanosecond short of two days
    assert find(predicates.newer("mtime", NOW, 0)) == ["/a/d"]
    assert find(predicates.hook(lambda p: p.endswith("d"))) == ["/a/d"]
    assert len(find()) == 6 and find(predicates.max_depth("/a", 0)) == []
    assert find(predicates.number("uid", "x")) == [] and len(find(predicates.number("uid", "+x"))) == 6


def test_filters_are_pushed_to_the_scan(spark, tmp_path):
    explicit(spark, [entry("/a")]).write.parquet(f"{tmp_path}/inv")
    plan = predicates.find(
        spark.read.parquet(f"{tmp_path}/inv"), predicates.size("+1k"), predicates.number("uid", "7")
    ).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size,1024)" in plan and "EqualTo(uid,7)" in plan and "ReadSchema: struct<path:string,uid:bigint,size:bigint>" in plan


def test_names(spark):
    df = explicit(spark, [entry("/a"), entry("/b", uid=5, gid=6), entry("/c", uid=None, gid=None)])
    users = spark.createDataFrame([(1, "u"), (1, "t"), (5, None)], "uid bigint, name string")
    groups = spark.createDataFrame([], "gid bigint, name string")
    assert rows(
        schema.with_names(df, users, groups), "path", "user", "group"
    ) == [("/a", "t", "2"), ("/b", "5", "6"), ("/c", None, None)]


def test_filters(spark, empty):
    df = explicit(
        spark,
        [
            entry("/t/a/x"),
            entry("/t/ab/y"),
            entry("/t/a"),
            entry("/u", 4, link_target="/t/./a//z"),
            entry("/v", 4, link_target="/t"),
            entry("/w", 4, link_target="t/a"),
        ],
    )
    inside, rest = filters.subtree(df, "/t/a")
    assert paths_of(inside) == ["/t/a/x"] and rest.count() == 5
    assert paths_of(filters.subtree(df, "/t/a", True)[0]) == ["/t/a", "/t/a/x"]
    assert paths_of(filters.children_like(df, "/t", "a*")[0]) == ["/t/a", "/t/a/x", "/t/ab/y"]
    assert filters.matching(df, None).count() == 0 and paths_of(filters.matching(df, "^x$", on_name=True)) == ["/t/a/x"]
    assert rows(filters.links_below(df, "/t"), "path", "target") == [("/u", "/t/a/z")]
    assert filters.links_below(empty, "/t").count() == 0
    assert rows(filters.under(df, "/t", "/t/a"), "path", "root") == [
        ("/t/a", "/t"), ("/t/a", "/t/a"), ("/t/a/x", "/t"), ("/t/a/x", "/t/a"), ("/t/ab/y", "/t")
    ]


def test_broken(spark):
    df = explicit(
        spark,
        [
            entry("/ok", size=2**50),
            entry("/big", size=2**50 + 1),
            entry("/future", atime=NOW + 1),
            entry("/old", ctime=NOW - 3650 * DAY - 1, size=2**50 + 1),
            entry("/edge", ctime=NOW - 3650 * DAY),
            entry("/dir", 3, size=2**51),
        ],
    )
    df = df.withColumn("error", F.when(F.col("path") == "/ok", "missing").when(F.col("path") == "/dir", "denied"))
    assert rows(filters.broken(df, NOW, "error"), "path", "flags") == [
        ("/big", 1), ("/dir", 8), ("/future", 2), ("/ok", 4), ("/old", 3)
    ]
    assert [r["path"] for r in filters.broken_sample(df, NOW, 2).collect()] == ["/big", "/future"]


def test_profiles(spark, empty):
    df = explicit(
        spark,
        [
            entry("/t/a", size=0),
            entry("/t/b", size=1),
            entry("/t/c/d", size=1024),
            entry("/t/e", 3, size=1025),
            entry("/t/f", size=None),
            entry("/t/g", size=2**40),
        ],
    )
    assert profile.summary(df).first().asDict() == dict(
        items=6, directories=1, files=5, links=0, unknown=0, bytes=1025 + 2**40, bytes_per_file=(1025 + 2**40) // 5
    )
    assert profile.summary(empty).first()["bytes_per_file"] == 0
    assert rows(profile.size_histogram(df), "upper", "number") == sorted(
        [(1, 2), (1024, 1), (2**20, 1), (2**30, 0), (2**40, 1)], key=repr
    )
    assert rows(profile.size_histogram(empty), "upper", "number") == [(1, 0)]
    assert rows(
        profile.size_distribution(df, "size:1k,0"), "bin", "lower", "upper", "number"
    ) == [(0, 0, 0, 1), (1, 0, 1024, 2), (2, 1024, None, 2)]
    for bad in ("", "size:", "age:1", "size:x"):
        with pytest.raises(ValueError):
            profile.parse_distribution(bad)
    assert [
        r["number"] for r in profile.file_size_profile(df).orderBy("bin").collect()
    ] == [3, 0, 0, 0, 0, 0, 0, 0, 1, 0]
    assert rows(profile.roll_up(df, "/t", 2), "child", "items", "bytes") == [("e", 1, 1025), ("g", 1, 2**40)]
    assert rows(profile.statistics(df), *["items", "longest", "min_depth", "max_depth"]) == [(6, 7, 2, 3)]


def test_hot_and_cold(spark):
    df = explicit(
        spark,
        [
            entry("/t/a/x", size=5, atime=NOW - 30 * DAY),
            entry("/t/a/y", size=7, atime=NOW - 90 * DAY),
            entry("/t/a", 3, size=9),
            entry("/t/b", 3),
            entry("/t/a/z", size=1, atime=None),
        ],
    )
    got = {r["directory"]: r for r in profile.hot_cold(profile.with_top(df, "/t"), "top", NOW, 90).collect()}
    a = got["/t/a"]
    assert (a["total"], a["cold"], a["day1"], a["day30"], a["day90"], a["ratio"]) == (13, 7, 0, 5, 12, 7 / 13)
    assert got["/t/b"]["ratio"] == 0.0 and got["/t/b"]["total"] == 0


def test_unique_inodes(spark):
    df = explicit(
        spark,
        [
            entry("/b", ino=1),
            entry("/a", ino=1),
            entry("/c", ino=2),
            entry("/d"),
            entry("/e"),
            entry("/f", ino=1, dev=None),
        ],
    )
    assert paths_of(profile.unique_inodes(df)) == ["/a", "/c", "/d", "/e", "/f"]


def test_order(spark, empty):
    r = random.Random(1)
    df = explicit(spark, [entry(f"/{i:03}", size=r.choice([None, 1, 2])) for i in range(100)])
    placed = order.numbered(df, order.sort_columns("-size", df.columns))
    expected = sorted(((x["size"] is None, -(x["size"] or 0), x["path"]) for x in df.collect()))
    assert [x["path"] for x in placed.orderBy("row_index").collect()] == [p for *_, p in expected]
    assert [x["row_index"] for x in placed.orderBy("row_index").collect()] == list(range(100))
    spread = order.even_spread(df, ["path"], 7)
    sizes = [x["count"] for x in spread.groupBy("bucket").count().orderBy("bucket").collect()]
    assert sizes == [15, 15] + [14] * 5
    assert order.numbered(empty, ["path"]).count() == 0 and order.even_spread(empty, ["path"], 3).count() == 0
    assert order.head_tail(df, "name", 2, 1).count() == 3 and order.head_tail(df, "name", 60, 60).count() == 100
    for bad in ("nope", "size,size", "user"):
        with pytest.raises(ValueError):
            order.sort_columns(bad, df.columns)
    one = order.running_before(df.repartition(9, "path"), ["path"], "size", "before").orderBy("path").collect()
    total = 0
    for x in one:
        assert x["before"] == total
        total += x["size"] or 0


def test_duplicates(spark):
    data = [
        ("/a", 2, "x"),
        ("/b", 2, "x"),
        ("/c", 2, "y"),
        ("/d", 2, ""),
        ("/e", 2, ""),
        ("/f", 2, None),
        ("/g", 3, "x"),
        ("/h", 2, "z"),
    ]
    df = spark.createDataFrame(data, "path string, type int, content string")
    assert rows(dedup.duplicates(df), "path", "group_size") == [("/a", 2), ("/b", 2)]
    assert rows(dedup.duplicate_groups(df), "first_path", "copies", "wasted") == [("/a", 2, 1)]
    assert dedup.duplicates(df.limit(0)).count() == 0


def test_duplicates_hash_each_candidate_once(spark, monkeypatch, tmp_path):
    data = [("/a", 2, 1, "x"), ("/b", 2, 1, "x"), ("/c", 2, 1, "y"), ("/d", 2, 2, "xy"), ("/e", 2, None, "zz"), ("/f", 2, None, ""), ("/g", 2, 3, None)]
    df = spark.createDataFrame(data, "path string, type int, size bigint, content string")
    df.write.parquet(f"{tmp_path}/f")
    plans, written = [], dedup.written

    def kept(rows_, what):
        plans.append(rows_._jdf.queryExecution().optimizedPlan().toString())
        return written(rows_, what)

    monkeypatch.setattr(dedup, "written", kept)
    for most in (dedup.MOST_SIZES, 0):
        monkeypatch.setattr(dedup, "MOST_SIZES", most)
        files = spark.read.parquet(f"{tmp_path}/f")
        assert rows(dedup.duplicates(files), "path", "group_size") == [("/a", 2), ("/b", 2)]
    sizes, digests, *_ = plans
    assert sizes.count("sha2") == 0 and digests.count("sha2(") == 1 and digests.count("Relation") == 2
    assert rows(dedup.hashed(df), "path") == [(f"/{c}",) for c in "abcde"]


def test_segmented_sums(spark):
    r = random.Random(3)
    data = [(r.choice(["hot"] * 5 + ["a", None]), r.randint(0, 9), i, r.choice([None, 1, -3, 5])) for i in range(300)] + [("one", 1, 999, 7)]
    df = spark.createDataFrame(data, "k string, o bigint, i bigint, v bigint")
    got = {}
    for backwards in (False, True):
        found = order.segmented_before(df, ["k"], [("o", True), ("i", False)], "v", "s", backwards)
        got[backwards] = {x["i"]: x["s"] for x in found.collect()}
    for k in {x[0] for x in data}:
        mine = sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2]))
        for at, x in enumerate(mine):
            assert got[False][x[2]] == sum(y[3] or 0 for y in mine[:at])
            assert got[True][x[2]] == sum(y[3] or 0 for y in mine[at + 1 :])
    assert order.segmented_before(df.limit(0), ["k"], [("o", True)], "v", "s").count() == 0


def test_chunks_and_archives(spark, empty):
    df = explicit(
        spark,
        [
            entry("/a", size=0),
            entry("/b", size=10),
            entry("/c", size=11),
            entry("/d", 3, size=99),
            entry("/e", size=None),
        ],
    )
    assert rows(chunks.chunks(df, 10)) == sorted(
        [("/a", 0, 0, 0, 0), ("/b", 0, 0, 10, 10), ("/c", 0, 0, 10, 11), ("/c", 1, 10, 1, 11)], key=repr
    )
    big = explicit(
        spark, [entry("/a", size=513), entry("/b", 1), entry("/c", 4), entry("/d", size=512), entry("/d", size=0)]
    )
    assert rows(chunks.archive_entries(big)) == sorted(
        [("/a", 1536, 0), ("/c", 512, 1536), ("/d", 512, 2048), ("/d", 1024, 2560)], key=repr
    )
    assert chunks.archive_entries(empty).count() == 0
    flagged = spark.createDataFrame(
        [("/a", None), ("/a", True), ("/b", None), ("/c", False)], "path string, hit boolean"
    )
    assert rows(chunks.any_chunk(flagged, "hit")) == [("/a", True), ("/b", False), ("/c", False)]
    placed = chunks.balanced(explicit(spark, [entry(f"/{i}", size=s << 26) for i, s in enumerate([5, 4, 3, 3, 3])]), 2)
    assert rows(chunks.assigned_bytes(placed), "worker", "bytes") == [(0, 8 << 26), (1, 10 << 26)]


def greedy(files, workers):
    """O11 in one loop: size descending, then path, to the least loaded worker, the lowest of equals."""
    loads, found = [0] * workers, []
    for path, size in sorted(files, key=lambda x: (-x[1], x[0])):
        worker = min(range(workers), key=lambda w: (loads[w], w))
        loads[worker] += size
        found.append((path, size, worker))
    return sorted(found, key=repr)


def test_balanced_is_the_greedy_rule_in_any_number_of_parts(spark):
    r = random.Random(5)
    sizes = [r.choice([5, 5, 7, r.randint(1, 9) << 8, r.randint(1, 1 << 30)]) for _ in range(2000)]
    files = [(f"/é{i}" if i % 7 == 0 else f"/{i}", s) for i, s in enumerate(sizes)] + [("/huge", 1 << 50), ("/huge2", 1 << 50)]
    df = explicit(spark, [entry(p, size=s) for p, s in files] + [entry("/dir", 3), entry("/none", size=None)])
    for part_rows in (100, 700, 10_000):
        assert rows(chunks.balanced(df, 8, 1, part_rows)) == greedy(files, 8)
    assert chunks.balanced(df.limit(0), 8, 1, 100).count() == 0


def test_balanced_beyond_a_hundred_thousand_files(spark):
    n = 100_500
    df = spark.range(n).select(
        F.concat(F.lit("/"), "id").alias("path"), F.lit(2).alias("type"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + chunks.LARGE).alias("size")
    )
    files = [tuple(r) for r in df.select("path", "size").collect()]
    assert rows(chunks.balanced(df, 8)) == greedy(files, 8)


def tree(spark, entries):
    return compare.relative_rows(explicit(spark, entries), "/r")


@pytest.fixture(scope="module")
def pair(spark):
    a = [
        entry("/r", 3),
        entry("/r/same"),
        entry("/r/size", size=1),
        entry("/r/ns", mtime_nsec=1),
        entry("/r/perm", mode=0o100600),
        entry("/r/type"),
        entry("/r/l1", 4, link_target="x"),
        entry("/r/l2", 4, link_target="xy"),
        entry("/r/dir", 3, size=1),
        entry("/r/only"),
        entry("/r/owner", uid=9),
        entry("/other"),
    ]
    b = [
        entry("/r", 3),
        entry("/r/same"),
        entry("/r/size", size=2),
        entry("/r/ns"),
        entry("/r/perm"),
        entry("/r/type", 3),
        entry("/r/l1", 4, link_target="x"),
        entry("/r/l2", 4, link_target="x"),
        entry("/r/dir", 3, size=2),
        entry("/r/extra"),
        entry("/r/owner"),
    ]
    return tree(spark, a), tree(spark, b)


def test_states(pair):
    got = {r["relpath"]: r.asDict() for r in compare.states(*pair).collect()}
    pick = lambda p, *f: tuple(got[p][x] for x in f)
    assert pick("same", "EXIST", "TYPE", "SIZE", "CONTENT", "MTIME") == ("COMMON",) * 5
    assert pick("size", "SIZE", "CONTENT") == ("DIFFER", "DIFFER")
    assert pick("ns", "MTIME", "CONTENT", "SIZE") == ("DIFFER", "DIFFER", "COMMON")
    assert pick("perm", "PERM", "TYPE", "CONTENT") == ("DIFFER", "COMMON", "COMMON")
    assert pick("type", "TYPE", "CONTENT", "SIZE") == ("DIFFER", "DIFFER", "COMMON")
    assert pick("l1", "CONTENT") == ("COMMON",) and pick("l2", "CONTENT") == ("DIFFER",)
    assert pick("dir", "SIZE") == ("COMMON",)
    assert pick("only", "EXIST", "TYPE") == ("ONLY_SRC", None) and pick(
        "extra", "EXIST", "CONTENT"
    ) == ("ONLY_DEST", None)
    assert "/other" not in got and "." in got


def test_expressions(pair):
    compared = compare.states(*pair)
    assert compare.needed(["CONTENT"]) == ["EXIST", "TYPE", "SIZE", "CONTENT"]
    assert compare.parse("EXIST=ONLY_SRC,@TYPE=DIFFER@,:out") == (
        [[("EXIST", "ONLY_SRC")], [("TYPE", "DIFFER")]], "out"
    )
    for bad in ("", "EXIST", "TYPE=ONLY_SRC", "X=COMMON", "TYPE=MAYBE"):
        with pytest.raises(ValueError):
            compare.parse(bad)
    report = {r["expression"]: (r["src"], r["dst"]) for r in compare.report(compared).collect()}
    assert report["EXIST=COMMON"] == (10, 10) and report["EXIST=DIFFER"] == (1, 1)
    assert report["EXIST=COMMON@CONTENT=DIFFER"] == (4, 4)
    assert rows(
        compare.conjunction_counts(compared, "EXIST=DIFFER,EXIST=ONLY_SRC,TYPE=DIFFER")
    ) == [(0, 1, 1), (2, 1, 1)]
    assert rows(
        compare.matched(compared, "EXIST=ONLY_DEST,TYPE=DIFFER")
    ) == [("extra", "dst"), ("type", "dst"), ("type", "src")]


def test_compare_with_itself_and_nothing(spark, pair):
    a, b = pair
    assert {tuple(set(r.asDict().values()) - {r["relpath"]}) for r in compare.states(a, a).collect()} == {("COMMON",)}
    nothing = tree(spark, [])
    assert compare.counters(compare.states(a, nothing)).first().asDict() == {"only_src": 11, "only_dst": 0, "common": 0}
    assert compare.states(nothing, nothing).count() == 0
    assert compare.common(a, b).count() + compare.missing(a, b).count() == a.count()


def test_first_row_of_a_path_counts(spark):
    df = explicit(
        spark, [entry("/r/a", size=1), entry("/r/a", size=2), entry("/r/b", mode=0) | {"mode": None}]
    ).withColumn("row_id", F.col("size"))
    assert rows(compare.relative_rows(df, "/r", "row_id"), "relpath", "size") == [("a", 1)]


def apply_plan(dst, planned, src):
    """The destination after the actions: what a faithful executor leaves."""
    state = {r["relpath"]: r.asDict() for r in dst.collect()}
    source = {r["relpath"]: r.asDict() for r in src.collect()}
    for r in sync.in_order(planned).collect():
        if r["action"] == "REMOVE":
            del state[r["relpath"]]
        elif r["action"] == "META_UPDATE":
            state[r["relpath"]] |= {c: r[c] for c in sync.STAT} | {"size": source[r["relpath"]]["size"]}
        else:
            state[r["relpath"]] = source[r["relpath"]] | {c: r[c] for c in sync.STAT}
    return state


def test_applying_the_plan_leaves_nothing_to_do(spark, pair):
    src, dst = pair
    planned = sync.actions(src, dst)
    state = apply_plan(dst, planned, src)
    after = spark.createDataFrame([tuple(v[c] for c in dst.columns) for v in state.values()], dst.schema)
    assert sync.actions(src, after).count() == 0
    kinds = {(r["relpath"], r["action"]) for r in planned.collect()}
    assert kinds == {
        ("size", "COPY"),
        ("ns", "COPY"),
        ("perm", "META_UPDATE"),
        ("type", "REMOVE"),
        ("type", "COPY"),
        ("l2", "SYMLINK_UPDATE"),
        ("dir", "META_UPDATE"),
        ("only", "COPY"),
        ("extra", "REMOVE"),
        ("owner", "META_UPDATE"),
    }
    assert ("extra", "REMOVE") not in {
        (r["relpath"], r["action"]) for r in sync.actions(src, dst, delete=False).collect()
    }
    assert sync.action_counts(planned).first()["copy"] == 4


def test_mirror(pair):
    got = {r["relpath"]: (r["do_remove"], r["do_copy"], r["do_refresh"]) for r in sync.mirror(*pair).collect()}
    assert got == {
        "size": (True, True, False),
        "ns": (True, True, False),
        "perm": (False, False, True),
        "type": (True, True, True),
        "l2": (True, True, False),
        "only": (False, True, False),
        "owner": (False, False, True),
    }
    coarse = {r["relpath"] for r in sync.mirror(*pair, nanoseconds=False, delete=True).collect()}
    assert "ns" not in coarse and "extra" in coarse


def test_order_of_actions(spark):
    src = tree(spark, [entry("/r/n", 3), entry("/r/n/m", 3), entry("/r/n/f")])
    dst = tree(spark, [entry("/r/o", 3), entry("/r/o/p", 3), entry("/r/o/p/f")])
    done = [(r["action"], r["relpath"]) for r in sync.in_order(sync.actions(src, dst)).collect()]
    assert done == [
        ("REMOVE", "o/p/f"), ("REMOVE", "o/p"), ("REMOVE", "o"), ("MKDIR", "n"), ("MKDIR", "n/m"), ("COPY", "n/f")
    ]
    now, late = sync.deferred(sync.actions(src, dst))
    assert now.count() == 4 and [r["relpath"] for r in late.collect()] == ["o/p", "o"]


def test_link_dest(spark):
    src = tree(spark, [entry("/r/a"), entry("/r/b"), entry("/r/c"), entry("/r/d", 3), entry("/r/e")])
    dst = tree(spark, [entry("/r/c", ino=5), entry("/r/e", ino=7)])
    old = tree(
        spark, [entry("/r/a"), entry("/r/b", size=11), entry("/r/c", ino=5), entry("/r/d", 3), entry("/r/e", ino=8)]
    )
    assert rows(sync.with_links(src, dst, old)) == [("a", "hardlink"), ("b", "copy"), ("d", "copy"), ("e", "replace")]


def test_safety(spark, pair):
    with pytest.raises(sync.UnsafeSync):
        sync.check(tree(spark, []))
    with pytest.raises(sync.UnsafeSync):
        sync.check(pair[0], chown=True, link_dest=True)
    assert sync.check(pair[0], delete=True) and not sync.check(pair[0], delete=True, source_errors=True)
    changed = {r["relpath"]: r for r in sync.override(pair[0], 7, None, 0o640, 0o750).collect()}
    assert changed["same"]["mode"] == 0o100640 and changed["dir"]["mode"] == 0o040750 and changed["l1"]["mode"] == 0o120777 and changed["l1"]["uid"] == 7


def test_changes(spark, empty):
    df = explicit(
        spark,
        [entry("/t", 3), entry("/t/a"), entry("/t/d", 3), entry("/t/d/l", 4, link_target="/t/a"), entry("/t/d/x", 1)],
    )
    assert [(r["path"], r["step"]) for r in changes.remove(df).collect()] == [
        ("/t/a", 0), ("/t/d/l", 0), ("/t/d/x", 0), ("/t/d", 1), ("/t", 2)
    ]
    assert changes.remove(empty).count() == 0
    assert rows(changes.relink(df, "/t", "/n", relative=True)) == [("/t/d/l", "/t/a", "../../n/a")]
    assert rows(
        changes.copy(df, "/t/d", "/z"), "destination", "action"
    ) == [("/z", "MKDIR"), ("/z/l", "SYMLINK"), ("/z/x", "MKNOD")]
    assert rows(changes.chmod(df, "go-r"), "path", "new_mode") == [("/t", 0o711), ("/t/a", 0o600), ("/t/d", 0o711)]
    assert rows(changes.chown(df, uid=3), "path", "new_uid", "new_gid") == [
        (p, 3, 2) for p in ("/t", "/t/a", "/t/d", "/t/d/l", "/t/d/x")
    ]
    assert rows(changes.with_parents(df.filter("path = '/t/d/x'"), "/t")) == [("/t/d",), ("/t/d/x",)]
    with pytest.raises(Exception, match="not below"):
        changes.with_parents(df, "/t/d").collect()
    assert changes.check_copy([("/a", 2), ("/b", 3)], "/d", 3) and not changes.check_copy([("/a", 2)], "/d", None)
    for bad in ([("/a", 2), ("/b", 2)], "/d", None), ([("/a", 3)], "/d", 2), ([], "/d", 3):
        with pytest.raises(ValueError):
            changes.check_copy(*bad)
    links = explicit(spark, [entry("/b", ino=3), entry("/a", ino=3), entry("/c", ino=4), entry("/d")])
    assert rows(changes.hard_links(links)) == [("/b", "/a")]
    laid = links.withColumn("stripe_count", F.lit(1)).withColumn("stripe_size", F.lit(4))
    assert changes.restripe(laid, 0, 2, 4)[1].first()["files"] == 4 and changes.restripe(laid, 0, 1, 4)[1].first()["files"] == 0


def test_contents_decide_where_they_are_compared(spark):
    a = tree(spark, [entry("/r/a", mtime=5), entry("/r/b"), entry("/r/c"), entry("/r/d")])
    b = tree(spark, [entry("/r/a"), entry("/r/b"), entry("/r/c"), entry("/r/d")])
    by_path = lambda **kw: F.coalesce(*[F.when(F.col("relpath") == k, v) for k, v in kw.items()], F.lit("same"))
    a = a.withColumn("content", by_path(b="x")).withColumn("digest", by_path(b="x", c="y"))
    b = b.withColumn("content", by_path()).withColumn("digest", F.when(F.col("relpath") != "d", by_path()))
    got = {r["relpath"]: r["CONTENT"] for r in compare.states(a, b, lite=False).collect()}
    assert got == {"a": "COMMON", "b": "DIFFER", "c": "COMMON", "d": "COMMON"}
    assert {r["relpath"]: r["CONTENT"] for r in compare.states(a, b, lite=True).collect()}["a"] == "DIFFER"
    planned = {(r["relpath"], r["action"]) for r in sync.actions(a, b, contents=True).collect()}
    assert planned == {("a", "META_UPDATE"), ("b", "COPY"), ("c", "COPY"), ("d", "COPY")}
    lists = {
        r["relpath"]: (
            r["do_remove"], r["do_copy"], r["do_refresh"]
        ) for r in sync.mirror(a, b, contents=True).collect()
    }
    assert lists == {"a": (False, False, True), "b": (False, True, False)}


def test_null_fields_equal_only_null(spark):
    a = tree(spark, [entry("/r/a", size=None), entry("/r/b", size=None, uid=None)])
    b = tree(spark, [entry("/r/a", size=None), entry("/r/b", size=3, uid=None)])
    got = {r["relpath"]: (r["SIZE"], r["UID"]) for r in compare.states(a, b).collect()}
    assert got == {"a": ("COMMON", "COMMON"), "b": ("DIFFER", "COMMON")}
    assert {r["relpath"] for r in sync.actions(a, b).collect()} == {"b"}


def test_write_matched(spark, pair, tmp_path):
    folders = compare.write_matched(compare.states(*pair), ["EXIST=ONLY_SRC:new", "EXIST=COMMON"], str(tmp_path))
    assert folders == [f"{tmp_path}/new"] and rows(spark.read.parquet(folders[0])) == [("only", "src")]


def test_owners_and_batches(spark, pair):
    planned = sync.owned(sync.actions(*pair), 3, 1)
    assert {r["src_owner"] for r in planned.filter("action = 'REMOVE'").collect()} == {-1}
    assert {r["dst_owner"] for r in planned.collect()} == {0}
    assert [order.batch_count(*x) for x in ((0, 0, 10), (10, 3, 10), (3, 11, 10), (5, 5, 0))] == [1, 1, 2, 1]


def test_progress(spark, tmp_path):
    from lakewalk.operators.progress import observed

    counted, observation = observed(explicit(spark, [entry("/a", size=3), entry("/b", size=None)]), "written")
    counted.write.parquet(f"{tmp_path}/x")
    assert observation.get == {"entries": 2, "bytes": 3}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    df = explicit(spark, [entry(f"/t/{i % 5}/{i}", size=i * 37 % 11, atime=NOW - i * DAY) for i in range(200)])
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = rows(
        profile.hot_cold(profile.with_top(df, "/t"), "top", NOW, 30)
    ), rows(profile.age_profile(df, NOW)), rows(chunks.archive_entries(df))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == (
        rows(profile.hot_cold(profile.with_top(df, "/t"), "top", NOW, 30)),
        rows(profile.age_profile(df, NOW)),
        rows(chunks.archive_entries(df)),
    )

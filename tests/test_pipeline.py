import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from lakewalk.operators import compaction, incremental, reconcile, snapshots, valuefreq
from lakewalk.operators.keyed_state import Conflict, KeyedState
from lakewalk.storage import Files, new_folder

FEED = "rec_id bigint, drop_id int, walk_no int, path string, size bigint, mtime bigint, ns bigint, k1 string, new string"


def feed_rows(n, seed=1, drops=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        path = r.choice(["hot"] * 5 + [f"p{k}" for k in range(12)] + [None])
        out.append(
            (
                i,
                1 + i * drops // n,
                r.randint(1, 4),
                path,
                r.choice([1, 2, None]),
                r.choice([5, 6]),
                r.choice([None, 0, 1]),
                "x",
                None,
            )
        )
    return out


def expected_changes(data, runs):
    out, before = [], {}
    for run, last in runs:
        state = {}
        for x in data:
            if last is None or x[1] <= last:
                key = (x[2], -x[0])
                if x[3] not in state or key > state[x[3]][0]:
                    state[x[3]] = (key, (x[4], x[5], x[6]), x[0])
        out += [(run, v[2]) for p, v in state.items() if p not in before or before[p][1] != v[1]]
        before = state
    return sorted(out)




def how():
    return dict(
        key=[F.col("path")],
        content=[F.col("size"), F.col("mtime"), F.col("ns")],
        rank=[F.col("walk_no"), -F.col("rec_id")],
        row_id=F.col("rec_id"),
    )


def test_incremental_matches_brute_force(spark):
    data = feed_rows(120)
    feed = spark.createDataFrame(data, FEED)
    runs = [(1, 1), (4, 1), (5, 3), (9, None)]
    state = KeyedState(spark, new_folder(spark, "t"))
    got = incremental.replay(state, feed, runs, "drop_id", **how())
    assert rows(got, "run_id", "row_id") == sorted(expected_changes(data, runs), key=repr)
    assert state.version == 1 and state.notes["run_id"] == 9
    one_by_one = KeyedState(spark, new_folder(spark, "t"))
    got = incremental.replay(one_by_one, feed, runs, "drop_id", **how(), at_once=1)
    assert rows(got, "run_id", "row_id") == sorted(expected_changes(data, runs), key=repr)
    assert one_by_one.version == 4


@pytest.mark.parametrize("step", ["arrive", "stage", "commit"])
def test_incremental_survives_failures(spark, monkeypatch, step):
    data = feed_rows(90, seed=2)
    feed = spark.createDataFrame(data, FEED)
    runs = [(1, 2), (2, 3), (3, None)]
    root = new_folder(spark, "t")
    incremental.replay(KeyedState(spark, root), feed, runs[:1], "drop_id", **how())
    real, failed = getattr(KeyedState, step), []

    def failing(self, *args, **kwargs):
        if not failed:
            failed.append(1)
            if step != "commit":
                real(self, *args, **kwargs)
            raise OSError("lost")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(KeyedState, step, failing)
    with pytest.raises(OSError):
        incremental.replay(KeyedState(spark, root), feed, runs, "drop_id", **how(), at_once=1)
    again = KeyedState(spark, root)
    assert again.version == 1
    got = incremental.replay(again, feed, runs, "drop_id", **how(), at_once=1)
    assert rows(got, "run_id", "row_id") == sorted(expected_changes(data, runs), key=repr)
    # What the lost attempt has written is named by no commit.
    assert again.vacuum(0) and not again.vacuum(0)
    assert rows(again.changes().filter("changed"), "row_id") == rows(got, "row_id")
    got = incremental.replay(KeyedState(spark, root), feed, runs, "drop_id", **how())
    assert got.count() == len(expected_changes(data, runs))


def test_two_writers_lose_nothing(spark):
    root = new_folder(spark, "t")
    made = lambda ids: spark.createDataFrame([(i, 1, 1, f"p{i}", i, 5, 0, "x", None) for i in ids], FEED)
    incremental.process_new(KeyedState(spark, root), made(range(10)), **how(), run=1)
    one, two = KeyedState(spark, root), KeyedState(spark, root)
    assert rows(incremental.process_new(one, made(range(10, 20)), **how(), run=2)) == [(2, i) for i in range(10, 20)]
    assert rows(incremental.process_new(two, made(range(15, 30)), **how(), run=3)) == [(3, i) for i in range(20, 30)]
    state = KeyedState(spark, root)
    assert state.version == 3 and state.current().count() == 30
    one, two = KeyedState(spark, root), KeyedState(spark, root)
    one.commit(one.live, one.current().schema, None, {})
    with pytest.raises(Conflict):
        two.commit(two.live, two.current().schema, None, {})


def test_one_run_is_shuffled_once_into_its_buckets(spark):
    state = KeyedState(spark, new_folder(spark, "t"), buckets=6)
    rows_ = spark.range(5000).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), "id")
    arrived = state.arrive(rows_.unionAll(rows_), F.struct("id"))
    assert len([n for n in Files(spark).names(arrived.folder()) if n.endswith(".parquet")]) == 6
    assert rows(arrived.of(0), "id") == sorted(((i,) for i in range(5000)), key=repr)
    arrived.close()


def test_many_claims_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    files, root = Files(spark), new_folder(spark, "t")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.put_new(f"{root}/a b/1.json", str(i)), range(16)))
    assert won.count(True) == 1 and files.read_text(f"{root}/a b/1.json") == str(won.index(True))
    assert files.names(f"{root}/a b") == ["1.json"]


def test_incremental_without_rows(spark):
    empty = spark.createDataFrame([], FEED)
    state = KeyedState(spark, new_folder(spark, "t"))
    assert rows(incremental.replay(state, empty, [(1, 1), (2, None)], "drop_id", **how())) == []


def test_state_folds_and_is_not_shuffled(spark, monkeypatch):
    from lakewalk.operators import keyed_state

    monkeypatch.setattr(keyed_state, "MOST_FOLDERS", 2)
    plans, stage = [], KeyedState.stage

    def kept(self, rows, base=False):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return stage(self, rows, base)

    monkeypatch.setattr(KeyedState, "stage", kept)
    data = feed_rows(80, drops=8)
    runs = [(i, i) for i in range(1, 9)]
    state = KeyedState(spark, new_folder(spark, "t"))
    got = incremental.replay(state, spark.createDataFrame(data, FEED), runs, "drop_id", **how(), at_once=1)
    assert rows(got, "run_id", "row_id") == sorted(expected_changes(data, runs), key=repr)
    assert state.version > 8 and len(state.live) <= 3 and [*state.live][0].endswith("-base")
    assert len([n for n in Files(spark).names(f"{state.root}/rows") if n.endswith("-base")]) <= 2
    assert plans and not any("Exchange" in p for p in plans)
    before = {(r["k1"], r["h"]) for r in state.current().groupBy("k1").agg(F.max(F.struct("r0", "r1", "h")).alias("m")).select("k1", "m.h").collect()}
    state.fold(F.struct("r0", "r1", "h", "row_id", "changed", "run"), buckets=7)
    assert state.buckets == 7 and {(r["k1"], r["h"]) for r in state.current().collect()} == before
    more = spark.createDataFrame([(1000, 9, 9, "p1", 77, 5, 0, "x", None)], FEED)
    assert rows(incremental.process_new(state, more, **how(), run_id=9)) == [(9, 1000)]


SNAP = "snap_row bigint, snap_id int, path string, size bigint, mtime bigint, kind string, h bigint"


def snap_rows(seed):
    r, out, k = random.Random(seed), [], 0
    for sid in (3, 5, 6, 9):
        for p in [f"p{i}" for i in range(20)] + [None, ""]:
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                k += 1
                out.append((k, sid, p, r.choice([1, 2, None]), 7, "x", 0))
    return out


@pytest.mark.parametrize("at_once", [1, 2, 9])
def test_snapshots_match_brute_force(spark, monkeypatch, at_once):
    plans, put_out = [], KeyedState.put_out

    def kept(self, changes):
        plans.append(changes._jdf.queryExecution().executedPlan().toString())
        return put_out(self, changes)

    monkeypatch.setattr(KeyedState, "put_out", kept)
    data = snap_rows(1)
    df = spark.createDataFrame(data, SNAP)
    index = KeyedState(spark, new_folder(spark, "t"))
    got = snapshots.changes_between(
        index, df, "snap_id", [3, 5, 6, 9], key="path", row_id="snap_row", fields=["size", "mtime"], at_once=at_once
    )
    state = defaultdict(dict)
    for x in sorted(data):
        state[x[1]].setdefault(x[2], x[3:5])
    expected = []
    for a, b in ((3, 5), (5, 6), (6, 9)):
        old, new = state[a], state[b]
        expected += [(b, p, "added", None, new[p][0]) for p in new.keys() - old.keys()] + [
            (b, p, "removed", old[p][0], None) for p in old.keys() - new.keys()
        ]
        expected += [(b, p, "changed", old[p][0], new[p][0]) for p in old.keys() & new.keys() if old[p] != new[p]]
    assert rows(got, "snap_id", "path", "change_kind", "old_size", "new_size") == sorted(expected, key=repr)
    # Neither the snapshots nor the last one's rows are moved again once they lie in the index's buckets.
    assert plans and not any("Exchange" in p for p in plans)
    last = spark.createDataFrame([(1, 12, "p1", 9, 9, "x", 0)], SNAP)
    got = snapshots.next_snapshot(index, last, "path", "snap_row", ["size", "mtime"], snap_id=12)
    kinds = rows(got, "snap_id", "path", "change_kind")
    assert len(kinds) == len(state[9].keys() | {"p1"}) and {k[2] for k in kinds} <= {"removed", "changed", "added"}


def test_snapshots_empty(spark):
    df = spark.createDataFrame(snap_rows(2), SNAP)
    index = KeyedState(spark, new_folder(spark, "t"))
    got = snapshots.changes_between(index, df, "snap_id", [3, 4], key="path", row_id="snap_row", fields=["size"])
    assert {r["change_kind"] for r in got.collect()} == {"removed"}
    assert got.count() == df.filter("snap_id = 3").select("path").distinct().count()


FRAGMENTS = "frag_id bigint, path string, type int, size bigint, dev bigint, ino bigint, content string, directory string, record string"


def fragment(i, path, content="a\n", type=2, size=None, dev=1, ino=None):
    return (i, path, type, size, dev, i if ino is None else ino, content, "x", None)


def test_compaction(spark):
    data = [fragment(i, f"/hot/f{i}", f"line {i}\r\nsecond\n\nlast") for i in range(30)]
    data += [fragment(100 + i, f"/few/f{i}") for i in range(7)]
    data += [fragment(200 + i, f"/mixed/f{i}", c) for i, c in enumerate(["a", "\n", "", None, "x" * 4096, "x" * 4097, "é" * 2048, "é" * 2049, "a\rb", "b", "c", "d", "e"])]
    data += [
        fragment(300, "/hot/link", ino=0),
        fragment(301, "/hot/dir", None, type=3, size=4096),
        fragment(302, "/hot/null", dev=None),
        fragment(303, "/hot/null", dev=None),
        fragment(304, "/hot/null content", None, size=7),
    ]
    files = spark.createDataFrame(data, FRAGMENTS)
    root = new_folder(spark, "t")
    packed = compaction.pack_fragments(files, root)
    ids = {r[0] for r in packed.select("frag_id").collect()}
    # 300 has the inode of fragment 0, which is the lower one; of /mixed nine fit, among them exactly 4096 bytes.
    assert ids == {*range(30), 302, 303, 304, 200, 201, 204, 206, 208, 209, 210, 211, 212}
    assert rows(packed.filter("frag_id = 1"), "rec_no", "record") == [
        (0, "line 1"), (1, "second"), (2, ""), (3, "last")
    ]
    assert rows(packed.filter("frag_id = 208"), "record") == [("a",), ("b",)]
    assert rows(packed.filter("frag_id = 201"), "record") == [("",)]
    assert rows(packed.filter("frag_id = 304"), "rec_no", "record") == [(None, None)]
    assert rows(compaction.committed(spark, root)) == rows(packed)


def test_compaction_commits_only_equal_multisets(spark, monkeypatch):
    files = spark.createDataFrame([fragment(i, f"/d/f{i}") for i in range(9)], FRAGMENTS)
    root = new_folder(spark, "t")
    before = rows(compaction.pack_fragments(files, root))
    real, calls = compaction.multiset, []
    monkeypatch.setattr(compaction, "multiset", lambda df: real(df) | {"n": calls.append(1) or -len(calls)})
    with pytest.raises(compaction.ChecksumMismatch):
        compaction.pack_fragments(files.filter("frag_id <> 0"), root)
    assert rows(compaction.committed(spark, root)) == before


def test_compaction_never_overwrites(spark, monkeypatch):
    pack = lambda n: compaction.compact(spark.range(n).withColumn("d", F.lit("x")), root, ["d"])
    root = new_folder(spark, "t")
    pack(10)
    pack(20)
    held = pack(50)
    folders = [n for n in Files(spark).names(root) if n.startswith("packed")]
    assert len(folders) == 2
    # A run that dies before its commit leaves readers what they had, whatever folders were removed.
    monkeypatch.setattr(compaction, "multiset", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pack(7)
    monkeypatch.undo()
    assert held.count() == 50 and compaction.committed(spark, root).count() == 50
    # Of two runs from the same version one commits.
    version = compaction._version
    monkeypatch.setattr(compaction, "_version", lambda *a: (version(*a)[0] - 1, {}))
    with pytest.raises(Conflict):
        pack(8)
    monkeypatch.undo()
    assert compaction.committed(spark, root).count() == 50


def test_multiset_sees_repetition(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    two = spark.createDataFrame([(1, None), (2, "a"), (2, "a")], "a int, b string")
    assert compaction.multiset(one) != compaction.multiset(two)
    assert compaction.multiset(one) == compaction.multiset(one.repartition(7))


def test_compaction_of_nothing(spark):
    assert compaction.pack_fragments(spark.createDataFrame([], FRAGMENTS), new_folder(spark, "t")).count() == 0


def test_numpy_hash_is_sparks(spark):
    numbers = [(0, -1), (2**63 - 1, -(2**63)), (12345, 678)]
    got = [r[0] for r in spark.createDataFrame(numbers, "a bigint, b bigint").select(F.xxhash64("a", "b")).collect()]
    a = np.array(numbers, np.int64)
    assert reconcile.xxhash64_longs(a[:, 0], a[:, 1]).tolist() == got


TREE = "row_id bigint, relpath string, type int, size bigint, mode int, link_target string, key string, h bigint"


def expected_differences(src, dst, fields):
    names = [c.split()[0] for c in TREE.split(", ")]
    side = []
    for data in (src, dst):
        first = {}
        for x in sorted(data, key=lambda x: x[0]):
            first.setdefault(x[1], dict(zip(names, x)))
        side.append(first)
    a, b = side
    out = [(p, "only_src") for p in a.keys() - b.keys()] + [(p, "only_dst") for p in b.keys() - a.keys()]
    for p in a.keys() & b.keys():
        out += [(p, f) for f in fields if a[p][f] != b[p][f] and not (f == "size" and a[p]["type"] == 3)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share,how", [(0.05, {}), (0.9, {}), (0.5, {"bucket_rows": 400, "widths": (8, 16)})])
def test_differences_match_brute_force(spark, share, how):
    """Few differences, nearly all, and more than any table can hold, which leaves the buckets to the exact comparison."""
    r = random.Random(3)
    src = [
        (i, f"p{i}", r.choice([2, 3]), r.choice([1, None]), 420, None, "k", 1) for i in range(1500)
    ] + [(9000, None, 2, 1, 1, None, "k", 1), (9001, "p1", 2, 99, 1, None, "k", 1)]
    dst = [list(x) for x in src if r.random() > share / 3]
    for x in dst:
        if r.random() < share:
            x[r.choice([3, 4, 5])] = r.choice([7, None]) if r.random() < 0.5 else 8
            x[5] = None if x[5] is None else str(x[5])
    dst = [tuple(x) for x in dst] + [(9999, "new", 2, 1, 1, "t", "k", 1)]
    fields = ["size", "mode", "link_target"]
    got = reconcile.differences(
        spark.createDataFrame(src, TREE),
        spark.createDataFrame(dst, TREE),
        "relpath",
        "row_id",
        fields,
        ignore={"size": F.col("src_type") == 3},
        **how,
    )
    assert rows(got) == expected_differences(src, dst, fields)


def test_repeated_keys_are_compared(spark):
    """Rows that a side has repeatedly: equal ones, and the same two in another order, which cancel in the tables."""
    row = lambda i, p, size: (i, p, 2, size, 1, None, "k", 1)
    src = [row(1, "a", 1), row(2, "a", 1), row(3, "b", 1), row(4, "b", 2), row(5, "c", 1), row(6, "d", 4), row(7, "d", 4), row(8, "d", 4)]
    dst = [row(1, "a", 1), row(3, "b", 2), row(4, "b", 1), row(5, "c", 1), row(6, "c", 1), row(7, "c", 9)]
    got = reconcile.differences(
        spark.createDataFrame(src, TREE), spark.createDataFrame(dst, TREE), "relpath", "row_id", ["size"]
    )
    assert rows(got) == [("b", "size"), ("d", "only_src")]


def test_peeling_ends(spark):
    r = np.random.default_rng(1)
    width = 40
    for entries in (5, 60, 4000):
        k1, e = r.integers(-(2**63), 2**63 - 1, (2, entries))
        copies = r.choice([-3, -1, 1, 2], entries)
        check = reconcile.xxhash64_longs(k1, e).view(np.uint64) >> np.uint64(32)
        halves = [x.view(np.uint64) >> np.uint64(s) & np.uint64(0xFFFFFFFF) for x in (k1, e) for s in (32, 0)]
        value = np.column_stack([*halves, check]).astype(np.int64)
        n, sums = np.zeros(3 * width, np.int64), np.zeros((3 * width, 5), np.int64)
        for at in reconcile._places(e, width):
            np.add.at(n, at, copies)
            np.add.at(sums, at, value * copies[:, None])
        found, number, ok = reconcile.peel(n, sums, width)
        assert ok == (entries < 4000)
        if ok:
            assert dict(zip(found.tolist(), number.tolist())) == dict(zip(k1.tolist(), copies.tolist()))


def test_differences_of_empty_sides(spark):
    some = spark.createDataFrame([(1, "a", 2, 1, 1, None, "k", 1)], TREE)
    none = spark.createDataFrame([], TREE)
    assert rows(reconcile.differences(some, none, "relpath", "row_id", ["size"])) == [("a", "only_src")]
    assert rows(reconcile.differences(none, some, "relpath", "row_id", ["size"])) == [("a", "only_dst")]
    assert rows(reconcile.differences(none, none, "relpath", "row_id", ["size"])) == []
    assert rows(reconcile.differences(some, some, "relpath", "row_id", ["size"])) == []


def brute_percentiles(data, ps):
    groups = defaultdict(list)
    for k, v in data:
        if v is not None:
            groups[k].append(v)
    out = []
    for k, vs in groups.items():
        vs.sort()
        for p in ps:
            rank = max(1, int(np.ceil(len(vs) * p)))
            out.append((k, p, len(vs), vs[rank - 1]))
    return sorted(out, key=repr)


def test_value_frequencies(spark):
    r = random.Random(5)
    extremes = [0, 1, -1, 2**62, 2**62 + 1, -(2**62), 2**63 - 1, 4096, 4097]
    data = [
        (
            r.choice([1, 1, 1, 1, 2, 3, None]),
            r.choice([r.choice(extremes), r.randint(0, 10**6), r.randint(-50, 50), None]),
        ) for _ in range(3000)
    ]
    data += [(4, None), (4, None), (5, 2**63 - 1)]
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "id bigint, v bigint, freq int")
    freq = valuefreq.compress(df.withColumnRenamed("id", "key_id"), ["key_id"], "v")
    ps = [0.0, 0.25, 0.5, 0.999, 1.0]
    assert rows(
        valuefreq.percentiles(freq, ["key_id"], ps), "key_id", "p", "n_values", "value"
    ) == brute_percentiles(data, ps)
    counts = {x["key_id"]: x for x in valuefreq.key_counts(freq, ["key_id"]).collect()}
    for k in {k for k, _ in data}:
        vs = [v for kk, v in data if kk == k and v is not None]
        row = counts[k]
        assert (row["n_rows"], row["n_values"], row["n_distinct"]) == (
            sum(kk == k for kk, _ in data), len(vs), len(set(vs))
        )
        if vs:
            assert int(row["total"]) == sum(vs)
            assert row["mode_value"] == min(
                set(vs), key=lambda v: (-vs.count(v), v)
            ) and row["mode_freq"] == max(map(vs.count, set(vs)))
        else:
            assert row["mode_value"] is None and row["total"] is None
    hot = valuefreq.hot_keys(valuefreq.key_counts(freq, ["key_id"]), len(data), 0.1)
    assert {x["key_id"] for x in hot.collect()} == {
        k for k in {1, 2, 3, 4, 5} if sum(kk == k for kk, _ in data) >= 0.1 * len(data)
    }


def test_percentiles_of_a_narrow_hot_key(spark):
    """Values that all lie in one cell are cut into finer cells until none has too many to sort."""
    values = [2**40 + i * i % 3001 for i in range(4000)]
    data = [(1, v) for v in values] + [(2, 2**40 + 1), (2, 2**40 + 1), (2, -5)]
    freq = valuefreq.compress(spark.createDataFrame(data, "a bigint, v bigint"), ["a"], "v")
    assert freq.select(valuefreq.cell(F.col("value"))).filter("a = 1").distinct().count() == 1
    ps = [0.0, 0.1, 0.5, 0.51, 0.99, 1.0]
    got = valuefreq.percentiles(freq, ["a"], ps, most=3)
    assert rows(got, "a", "p", "n_values", "value") == brute_percentiles(data, ps)


def test_value_frequencies_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") * 7919 % 1009).alias("v"))
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows(valuefreq.percentiles(valuefreq.compress(df, ["a"], "v"), ["a"], [0.5, 0.9])))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    assert valuefreq.percentiles(valuefreq.compress(df.limit(0), ["a"], "v"), ["a"], [0.5]).count() == 0

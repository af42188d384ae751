import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewalk.functions import hashes, modes, paths, patterns, units


def values(spark, column, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_reduced(spark):
    cases = {
        "/a/./b//c/": "/a/b/c",
        "/..": "/",
        "/a/../..": "/",
        "a/../../b": "../b",
        "": "",
        "./": "",
        "/": "/",
        "../../x/..": "../..",
        "/é/..ä/.": "/é/..ä",
    }
    assert values(spark, paths.reduced, *cases) == list(cases.values())
    assert values(spark, paths.reduced, None) == [None]


def test_absolute(spark):
    assert values(spark, lambda c: paths.absolute(c, "/cwd/x"), "../a", "/b/..", "") == ["/cwd/a", "/", "/cwd/x"]


def test_parts(spark):
    cases = ["/a/b/c", "/a", "x", "/", "/a/"]
    assert values(spark, paths.basename, *cases) == ["c", "a", "x", "", ""]
    assert values(spark, paths.dirname, *cases) == ["/a/b", "/", ".", "/", "/a"]
    assert values(spark, paths.depth, *cases) == [3, 1, 0, 1, 2]
    assert values(spark, paths.relative_depth, ".", "a", "a/b") == [0, 1, 2]
    assert values(spark, lambda c: paths.part(c, 1, 2), "/a/b/c", "/a") == ["a/b", "a"]
    assert values(spark, lambda c: paths.part(c, -2), "/a/b/c", "x") == ["b/c", "x"]
    assert values(spark, paths.ancestors, "/a/b/c", "/a", None) == [["/a", "/a/b"], [], []]


def test_relations(spark):
    assert values(spark, lambda c: paths.compare(c, F.lit("/a/b")), "/a/b", "/a/b/c", "/a", "/a/bc", None) == ["EQUAL", "SRC_CHILD", "DEST_CHILD", "DIFF", None]
    assert values(spark, lambda c: paths.relative(F.lit("/a/b/c"), c), "/a/b/c", "/a/x", "/a/b/c/d", "/a/b", "/z") == ["", "../../x", "d", "..", "../../../z"]
    assert values(spark, lambda c: paths.destination(c, "/a", "/b/"), "/a", "/a/x", "/ab") == ["/b", "/b/x", None]
    assert values(spark, lambda c: paths.child_of(c, "/a"), "/a", "/a/x/y", "/ab/c") == [None, "x", None]
    assert values(spark, lambda c: paths.below_root(c, "/a/"), "/a", "/a/x", "/b") == [".", "x", None]


def test_sizes():
    assert [
        units.parse_size(x) for x in ("0", "1k", "1.5M", "10GB", "2tb", " 7")
    ] == [0, 1024, 1572864, 10 << 30, 2 << 40, 7]
    for bad in ("", "k", "1x", "-1", "1kbb", "1b", "16e", "20E"):
        with pytest.raises(ValueError):
            units.parse_size(bad)
    assert [
        units.parse_number(x) for x in ("+7", "-7", "7", "x", "", "+x", "7x")
    ] == [("+", 7), ("-", 7), ("", 7), ("", 0), ("", 0), ("+", 0), ("", 7)]


def test_units(spark):
    def shown(f, *numbers):
        return [(round(v, 3), u) for v, u in zip(values(spark, lambda c: f(c)[0], *numbers, kind="bigint"), values(spark, lambda c: f(c)[1], *numbers, kind="bigint"))]

    assert shown(units.bytes_and_unit, 0, 1000, 1005, 1024, 1025, 1 << 20, 2**60, 2**63 - 1) == [
        (0, "B"), (1000, "B"), (0.981, "KiB"), (1.0, "KiB"), (1.001, "KiB"), (1.0, "MiB"), (1.0, "EiB"), (8.0, "EiB")
    ]
    assert shown(units.count_and_unit, 1000, 1001, 2_000_000) == [(1000, ""), (1.001, "k"), (2.0, "M")]
    assert values(spark, lambda c: units.bytes_and_unit(c)[1], None, kind="bigint") == [None]


def test_ages(spark):
    now = 10 * 86400
    assert values(spark, lambda c: units.age_days(c, now), now, now - 86399, now - 86400, now + 5, None, kind="bigint") == [0, 0, 1, 0, None]
    age = lambda c: units.age_units(c, F.lit(1).cast("bigint"), now, 0, 60)
    assert values(spark, age, now - 60, now - 61, now, None, kind="bigint") == [0, 1, 0, None]
    assert values(
        spark, units.display_time, 1767225600 - 86400 * 25, None, kind="bigint"
    ) == ["Dec  7 2025 00:00", None]


def apply(spark, change, mode, directory=False, umask=0o022):
    df = spark.range(1).select(modes.changed(F.lit(mode), F.lit(directory), change, umask))
    return df.first()[0]


def test_modes(spark):
    assert apply(spark, "u+x,g-w", 0o664) == 0o744
    assert apply(spark, "a+X", 0o644) == 0o644
    assert apply(spark, "a+X", 0o644, True) == 0o755
    assert apply(spark, "g+X", 0o744) == 0o754
    assert apply(spark, "go-X", 0o755, False) == 0o744
    assert apply(spark, "u-X", 0o755, False) == 0o755
    assert apply(spark, "g=u,o=g", 0o700) == 0o777
    assert apply(spark, "+w", 0o444) == 0o644
    assert apply(spark, "4750", 0o100644) == 0o4750
    assert apply(spark, "u-r", 0o4755) == 0o4355
    for bad in ("u=rw", "u", "z+r", "u+rq", ",", "75500", "u=a"):
        with pytest.raises(ValueError):
            modes.parse_change(bad)
    assert values(
        spark, modes.mode_string, 0o100644, 0o040755, 0o120777, 0o104755, None, kind="int"
    ) == ["-rw-r--r--", "drwxr-xr-x", "lrwxrwxrwx", "-rwxr-xr-x", None]
    assert values(spark, modes.type_of, 0o100644, 0o040755, 0o120777, 0o010000, None, kind="int") == [2, 3, 4, 1, None]
    assert modes.parse_override("D0755,F0644") == (0o644, 0o755) and modes.parse_override("0750") == (0o750, 0o750)


def test_globs(spark):
    cases = [
        ("*.txt", "a.txt", True),
        ("*.txt", ".txt", False),
        (".*", ".x", True),
        ("?x", ".x", False),
        ("a*c", "a/b/c", True),
        ("[!a-c]x", "dx", True),
        ("[!a-c]x", "bx", False),
        ("a[", "a[", True),
        (r"a\*", "a*", True),
        (r"a\*", "ab", False),
        ("[[:digit:]]*", "7z", True),
        ("", "", True),
        ("*", "a\nb", True),
        ("[]x]", "]", True),
        ("a+b", "a+b", True),
    ]
    for pattern, text, expected in cases:
        assert values(spark, lambda c, p=pattern: c.rlike(patterns.glob(p)), text) == [expected], (pattern, text)


def test_regular_expressions(spark):
    cases = [
        ("a+", "a+", True),
        ("a+", "aa", False),
        (r"a\{2\}", "aa", True),
        (r"\(ab\)*c", "ababc", True),
        ("*a", "*a", True),
        (r"x\|y", "y", True),
        ("a|b", "b", False),
        ("^a.*z$", "a--z", True),
        ("a^b", "a^b", True),
        ("a$b", "a$b", True),
        ("[[:upper:]]", "a", False),
        (r"\.", "x", False),
        ("(a)", "(a)", True),
        (r"\(a\)\1", "aa", True),
    ]
    for pattern, text, expected in cases:
        assert values(spark, lambda c, p=pattern: c.rlike(patterns.basic(p)), text) == [expected], (pattern, text)
    assert values(spark, lambda c: c.rlike(patterns.extended("^(a|b)+[[:digit:]]{2}$")), "ab12", "c12") == [True, False]
    assert values(spark, lambda c: c.rlike(patterns.child_pattern("a*z")), "abz", "az", "azb") == [True, True, False]


def jenkins(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h + b) & 0xFFFFFFFF
        h = (h + (h << 10)) & 0xFFFFFFFF
        h ^= h >> 6
    h = (h + (h << 3)) & 0xFFFFFFFF
    h ^= h >> 11
    return (h + (h << 15)) & 0xFFFFFFFF


@given(st.lists(st.text(max_size=12), min_size=1, max_size=6))
def test_hashes(texts):
    series = pd.Series(texts)
    assert hashes.one_at_a_time(series).tolist() == [jenkins(t.encode()) for t in texts]
    assert hashes.one_at_a_time(series, 7).tolist() == [jenkins(b"\x07\0\0\0" + t.encode()) for t in texts]
    expected = []
    for t in texts:
        h = hashes.FNV_START
        for b in t.encode():
            h = ((h ^ b) * hashes.FNV_FACTOR) % 2**64
        expected.append(h)
    assert hashes.fnv1a(series).tolist() == expected


def test_hash_columns(spark):
    assert values(spark, hashes.jenkins, "a", None) == [jenkins(b"a"), None]
    assert np.int64(values(spark, hashes.fnv, "")[0]) == hashes.FNV_START

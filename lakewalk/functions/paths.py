"""Paths as columns: strings of components divided by slashes, compared byte by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def components(path: Column | str) -> Column:
    """The components; the first one of an absolute path is empty."""
    return F.split(_col(path), "/")


def count(path: Column | str) -> Column:
    return F.size(components(path))


def basename(path: Column | str) -> Column:
    """The last component; '' after a closing slash."""
    return F.substring_index(_col(path), "/", -1)


def dirname(path: Column | str) -> Column:
    """What comes before the last slash; '/' for entries of the root, '.' without any slash."""
    path = _col(path)
    head = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(F.instr(path, "/") == 0, ".").when(head == "", "/").otherwise(head)


def depth(path: Column | str) -> Column:
    """The number of slashes."""
    path = _col(path)
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def relative_depth(relpath: Column | str) -> Column:
    """0 for '.', else one more than the number of slashes."""
    relpath = _col(relpath)
    return F.when(relpath == ".", 0).otherwise(depth(relpath) + 1)


def reduced(path: Column | str) -> Column:
    """Without '.', empty components and what '..' undoes. '..' at the root is dropped, leading '..' of a relative path
    are kept; the empty path and one that is undone wholly give '/' if absolute, else ''."""
    path = _col(path)
    parts = F.filter(components(path), lambda c: (c != "") & (c != "."))
    absolute = path.startswith("/")
    step = lambda done, c: (
        F.when(c != "..", F.concat(done, F.array(c)))
        .when(
            (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .otherwise(F.when(absolute, done).otherwise(F.concat(done, F.array(c))))
    )
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # The fold runs for paths only that have something to reduce.
    return F.when(
        path.rlike(r"//|(^|/)\.\.?(/|$)|[^/]/$"), F.concat(F.when(absolute, "/").otherwise(""), F.array_join(kept, "/"))
    ).otherwise(path)


def absolute(path: Column | str, cwd: str) -> Column:
    """Reduced, after ``cwd`` unless it is absolute."""
    path = _col(path)
    return reduced(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path)))


def is_below(path: Column | str, parent: Column | str, inclusive: bool = False) -> Column:
    """Whether ``path`` lies strictly below ``parent`` by components (or is it, if ``inclusive``). With a parent given as
    text the test is pushed to the scan."""
    path = _col(path)
    if isinstance(parent, str):
        prefix, parent = parent.rstrip("/") + "/", F.lit(parent)
        below = path.startswith(prefix)
    else:
        below = path.startswith(F.concat(F.rtrim(parent, F.lit("/")), F.lit("/")))
    return below | (path == parent) if inclusive else below & (path != parent)


def compare(a: Column | str, b: Column | str) -> Column:
    """EQUAL, SRC_CHILD (a lies below b), DEST_CHILD (b below a) or DIFF."""
    a, b = _col(a), _col(b)
    return F.when(a == b, "EQUAL").when(is_below(a, b), "SRC_CHILD").when(is_below(b, a), "DEST_CHILD").when(
        a.isNotNull() & b.isNotNull(), "DIFF"
    )


def relative(start: Column | str, target: Column | str) -> Column:
    """How to get from the directory ``start`` to ``target``: '..' for each component of start after the common ones, then
    the rest of target. '' for equal paths."""
    a, b = components(start), components(target)
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    common = F.aggregate(
        both,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")),
        lambda s,
        x: F.when(
            s["go"] & (x["a"] == x["b"]), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("go"))
        ).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("go"))),
    )["n"]
    ups = F.transform(F.sequence(F.lit(1), F.size(a) - common), lambda _: F.lit(".."))
    ups = F.when(F.size(a) > common, ups).otherwise(F.array().cast("array<string>"))
    rest = F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))
    return F.array_join(F.concat(ups, rest), "/")


def part(path: Column | str, offset: int, length: int = -1) -> Column:
    """``length`` components from ``offset`` (from 0; negative: from the end), to the end if ``length`` is negative."""
    parts = components(path)
    start = F.lit(offset) if offset >= 0 else F.size(parts) + offset
    start = F.greatest(start, F.lit(0))
    most = F.greatest(F.size(parts) - start, F.lit(0))
    return F.array_join(F.slice(parts, start + 1, most if length < 0 else F.least(most, F.lit(length))), "/")


def joined(*parts: Column | str) -> Column:
    """Paths put one after the other, with one slash between."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    first, *rest = cols
    return F.concat_ws("/", F.regexp_replace(first, "/+$", ""), *[F.regexp_replace(c, "^/+|/+$", "") for c in rest])


def below_root(path: Column | str, root: str) -> Column:
    """The path relative to ``root``: '.' for the root itself, null outside it."""
    path, root = _col(path), root.rstrip("/")
    return F.when(path == root, ".").when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 2**31 - 1))


def destination(path: Column | str, source: str, dest: str) -> Column:
    """Where an entry at or below ``source`` is copied to: the same place at or below ``dest``; null outside."""
    path, source, dest = _col(path), source.rstrip("/"), dest.rstrip("/")
    return F.when(path == source, dest).when(
        path.startswith(source + "/"), F.concat(F.lit(dest), F.substring(path, len(source) + 1, 2**31 - 1))
    )


def child_of(path: Column | str, parent: str) -> Column:
    """The first component below ``parent``; null for other paths."""
    parent = parent.rstrip("/")
    path = _col(path)
    return F.when(
        path.startswith(parent + "/"), F.substring_index(F.substring(path, len(parent) + 2, 2**31 - 1), "/", 1)
    )


def ancestors(path: Column | str) -> Column:
    """All directories above an absolute path, the root left out, from the top."""
    parts = components(path)
    n = F.size(parts) - 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(2), F.greatest(n + 1, F.lit(2))), lambda k: F.array_join(F.slice(parts, F.lit(1), k.cast("int")), "/"))).otherwise(F.array().cast("array<string>"))

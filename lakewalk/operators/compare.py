"""Comparison of two trees, field by field, and the expressions that count its outcomes.

Each field of an entry on both sides is COMMON or DIFFER; EXIST is COMMON, ONLY_SRC or ONLY_DEST. Fields of entries that
only one side has are null: not evaluated. The join is a hash or merge join on the relative path, as Spark finds best.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewalk import schema
from lakewalk.functions import modes, paths

#: Names of fields and states in expressions. Fixed values.
FIELDS = ["EXIST", "TYPE", "SIZE", "UID", "GID", "ATIME", "MTIME", "CTIME", "PERM", "ACL", "CONTENT"]
STATES = ["COMMON", "DIFFER", "ONLY_SRC", "ONLY_DEST"]
#: What has to be compared too, for a field to be compared.
NEEDS = {
    "TYPE": ["EXIST"],
    "SIZE": ["TYPE"],
    "CONTENT": ["SIZE"],
    **{f: ["EXIST"] for f in ("UID", "GID", "ATIME", "MTIME", "CTIME", "PERM", "ACL")},
}
#: The default reports. Fixed values.
COMPARE_REPORT = [
    "EXIST=COMMON",
    "EXIST=DIFFER",
    "EXIST=COMMON@TYPE=COMMON",
    "EXIST=COMMON@TYPE=DIFFER",
    "EXIST=COMMON@CONTENT=COMMON",
    "EXIST=COMMON@CONTENT=DIFFER",
]
SYNC_REPORT = [*COMPARE_REPORT, *[f"EXIST=COMMON@{f}=DIFFER" for f in ("UID", "GID", "PERM", "ATIME", "MTIME")]]


def needed(fields: Iterable[str]) -> list[str]:
    """The fields with all that they depend on, in the usual order."""
    todo, done = list(fields), set()
    while todo:
        if (f := todo.pop()) not in done:
            done.add(f)
            todo += NEEDS.get(f, [])
    return [f for f in FIELDS if f in done]


def relative_rows(rows: DataFrame, root: str, row_id: str | None = None) -> DataFrame:
    """The rows at and below ``root`` with ``relpath``, without those whose stat failed. Of rows with the same path the one
    with the lowest ``row_id`` counts; without one the paths have to be unique."""
    inside = rows.filter(
        F.col("mode").isNotNull() & paths.is_below("path", root, inclusive=True)
    ).withColumn("relpath", paths.below_root("path", root))
    if row_id is None:
        return inside
    rest = [c for c in inside.columns if c not in (row_id, "relpath")]
    return inside.groupBy("relpath").agg(F.min(F.struct(row_id, *rest)).alias("r")).select("relpath", "r.*")


def paired(src: DataFrame, dst: DataFrame) -> DataFrame:
    """relpath and the rows of either side as structs s and d; a missing row is null."""
    side = lambda df, name: df.select("relpath", F.struct(*[c for c in df.columns if c != "relpath"]).alias(name))
    return side(src, "s").join(side(dst, "d"), "relpath", "full_outer")


def _state(same: Column) -> Column:
    return F.when(same, "COMMON").otherwise("DIFFER")


def _equal(name: str) -> Column:
    return F.col(f"s.{name}").eqNullSafe(F.col(f"d.{name}"))


def states(
    src: DataFrame, dst: DataFrame, fields: Sequence[str] = FIELDS, lite: bool = True, nanoseconds: bool = True
) -> DataFrame:
    """relpath and the state of every field of ``fields`` and those they need, as far as both sides have their columns.

    SIZE of directories of the source is always COMMON. Differing types make CONTENT differ. CONTENT of links compares
    their targets; of files it differs if the sizes do, else it compares mtimes (lite) or ``content``; other types are
    COMMON. Times compare with their nanoseconds unless ``nanoseconds`` is off. Null equals only null.
    """
    columns = set(src.columns) & set(dst.columns)
    pairs = paired(src, dst)
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    time = lambda c: _equal(c) & (_equal(f"{c}_nsec") if nanoseconds and f"{c}_nsec" in columns else F.lit(True))
    same_type = modes.format_bits(F.col("s.mode")) == modes.format_bits(F.col("d.mode"))
    format_ = modes.format_bits(F.col("d.mode"))
    same_size = (F.col("s.type") == schema.DIRECTORY) | _equal("size")
    mtime = _equal("mtime") & (_equal("mtime_nsec") if "mtime_nsec" in columns else F.lit(True))
    same_content = (
        F.when(~same_type, False)
        .when(format_ == schema.LINK_MODE, _equal("link_target") if "link_target" in columns else F.lit(True))
        .when(format_ != schema.REGULAR, True)
        .when(~same_size, False)
        .otherwise(mtime if lite or "content" not in columns else _equal("content"))
    )
    tests = {
        "TYPE": same_type,
        "SIZE": same_size,
        "UID": _equal("uid"),
        "GID": _equal("gid"),
        "PERM": modes.permissions(F.col("s.mode")) == modes.permissions(F.col("d.mode")),
        "CONTENT": same_content,
    }
    tests |= {c.upper(): time(c) for c in ("atime", "mtime", "ctime") if c in columns}
    if "acl" in columns:
        tests["ACL"] = _equal("acl")
    exist = F.when(both, "COMMON").when(F.col("s").isNotNull(), "ONLY_SRC").otherwise("ONLY_DEST")
    wanted = [f for f in needed(fields) if f in tests]
    return pairs.select("relpath", exist.alias("EXIST"), *[F.when(both, _state(tests[f])).alias(f) for f in wanted])


def parse(text: str) -> tuple[list[list[tuple[str, str]]], str | None]:
    """'F=S@F=S,F=S:file' as (conjunctions of (field, state), file). Empty terms are skipped; unknown fields or states, and
    ONLY_ states of other fields than EXIST, raise ValueError."""
    text, _, file = text.partition(":")
    either = []
    for conjunction in filter(None, text.split(",")):
        terms = []
        for term in filter(None, conjunction.split("@")):
            field, _, state = term.partition("=")
            if field not in FIELDS or state not in STATES or (state.startswith("ONLY_") and field != "EXIST"):
                raise ValueError(f"not an expression: {term!r}")
            terms.append((field, state))
        if terms:
            either.append(terms)
    if not either:
        raise ValueError("an empty expression")
    return either, file or None


def fields_of(expressions: Iterable[str]) -> list[str]:
    return needed({f for e in expressions for terms in parse(e)[0] for f, _ in terms})


def _term(field: str, state: str) -> Column:
    if field == "EXIST" and state == "DIFFER":
        return F.col("EXIST") != "COMMON"
    return F.coalesce(F.col(field) == state, F.lit(False))


def matches(expression: str) -> Column:
    """The number of the first conjunction that an entry satisfies, from 0; null if none. Entries of one side satisfy
    nothing but states of EXIST: ONLY_SRC or ONLY_DEST, or DIFFER."""
    found = F
    for i, terms in enumerate(parse(expression)[0]):
        found = found.when(reduce(lambda a, b: a & b, [_term(*t) for t in terms]), i)
    return found


def report(compared: DataFrame, expressions: Sequence[str] = COMPARE_REPORT) -> DataFrame:
    """expression, src and dst: how many entries of either side satisfy each, in one pass; an entry on both sides counts on
    both."""
    counts = []
    for i, e in enumerate(expressions):
        hit = matches(e).isNotNull()
        counts += [
            F.count_if(hit & (F.col("EXIST") != "ONLY_DEST")).alias(f"s{i}"),
            F.count_if(hit & (F.col("EXIST") != "ONLY_SRC")).alias(f"d{i}"),
        ]
    row = compared.agg(*counts)
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("expression"), F.col(f"s{i}").alias("src"), F.col(f"d{i}").alias("dst")) for i, e in enumerate(expressions)]))
    return row.select(each.alias("r")).select("r.*")


def conjunction_counts(compared: DataFrame, expression: str) -> DataFrame:
    """conjunction (its number), src and dst: an entry counts for the first conjunction that it satisfies."""
    hit = compared.withColumn("conjunction", matches(expression)).filter("conjunction IS NOT NULL")
    return hit.groupBy("conjunction").agg(
        F.count_if(F.col("EXIST") != "ONLY_DEST").alias("src"), F.count_if(F.col("EXIST") != "ONLY_SRC").alias("dst")
    )


def matched(compared: DataFrame, expression: str) -> DataFrame:
    """The entries that satisfy an expression: relpath and side, src before dst; those on both sides twice."""
    hit = compared.filter(matches(expression).isNotNull())
    sides = F.explode(
        F.array_compact(
            F.array(F.when(F.col("EXIST") != "ONLY_DEST", "src"), F.when(F.col("EXIST") != "ONLY_SRC", "dst"))
        )
    )
    return hit.select("relpath", sides.alias("side"))


def write_matched(compared: DataFrame, expressions: Sequence[str], root: str) -> list[str]:
    """Write the entries of every expression that names a file ('EXPR:FILE') below ``root``; the folders written."""
    written = []
    for e in expressions:
        _, file = parse(e)
        if file:
            matched(compared, e).write.mode("overwrite").parquet(f"{root}/{file}")
            written.append(f"{root}/{file}")
    return written


def counters(compared: DataFrame) -> DataFrame:
    """One row: only_src, only_dst and common."""
    return compared.agg(*[F.count_if(F.col("EXIST") == s).alias(n) for s, n in (("ONLY_SRC", "only_src"), ("ONLY_DEST", "only_dst"), ("COMMON", "common"))])


def common(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Rows of src whose relpath dst has."""
    return src.join(dst.select("relpath"), "relpath", "left_semi")


def missing(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Rows of src whose relpath dst lacks."""
    return src.join(dst.select("relpath"), "relpath", "left_anti")


def symmetric_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """relpath and side of the entries that one side has."""
    return missing(src, dst).select("relpath", F.lit("src").alias("side")).unionAll(
        missing(dst, src).select("relpath", F.lit("dst").alias("side"))
    )

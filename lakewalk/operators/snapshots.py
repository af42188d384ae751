"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.operators.keyed_state import KEYS, Arrivals, Conflict, KeyedState, content_hash, key_columns

#: So many snapshots are brought into the index by one commit.
SNAPSHOTS_AT_ONCE = 4


def _bucketed(index: KeyedState, snapshots: DataFrame, key: str, row_id: str, fields: Sequence[str], snap: str | None = None):
    """Rows of one or several snapshots as the index keeps them: hashed, one row per key, in its buckets."""
    columns = [
        F.col(row_id).alias("id"),
        content_hash(*map(F.col, fields)).alias("h"),
        F.col(key).alias("key"),
        *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)],
    ]
    more = [F.col(snap).alias("snap")] if snap else []
    hashed = snapshots.select(*more, *key_columns(F.col(key)), *columns)
    # The greatest of the negated ids is the lowest id.
    best = F.struct((-F.col("id")).alias("neg"), "h", "key", *[f"f{i}" for i in range(len(fields))])
    return index.arrive(hashed, best, "snap" if snap else None)


def _steps(
    index: KeyedState, arrived: Arrivals, steps: Sequence[int], key: str, fields: Sequence[str], notes: dict, note: str | None
) -> bool:
    """Probe the index with some consecutive snapshots, each of which is compared with the one before, and make the last one's
    rows the index. False if another writer was first."""
    names = [f"f{i}" for i in range(len(fields))]
    folders = {i + 1: arrived.folder(s) for i, s in enumerate(steps)}
    first = 0 if index.version else 1
    if index.version and index.live:
        folders[0] = [*index.live][0]
    folders = {i: f for i, f in folders.items() if f}
    schema, changes, kind_of = arrived.of(*steps).drop("_step").schema, None, None
    if first < len(steps):
        rows = index.opened_by([*folders.values()], schema, [*folders])
        # All lie in the same buckets, so nothing moves. The probe reads keys and hashes; fields are fetched for what it finds.
        by_key = Window.partitionBy(*KEYS).orderBy("step")
        there = rows.select(*KEYS, "step", "h").select(
            *KEYS,
            "step",
            "h",
            F.lag("step").over(by_key).alias("before"),
            F.lag("h").over(by_key).alias("_h"),
            F.lead("step").over(by_key).alias("after"),
        )
        step = F.col("step")
        follows = F.coalesce(F.col("before") == step - 1, F.lit(False))
        kinds = F.array_compact(
            F.array(
                F.when((step > first) & ~follows, F.struct(F.lit("added").alias("kind"), step.alias("at"))),
                F.when(follows & (F.col("_h") != F.col("h")), F.struct(F.lit("changed").alias("kind"), step.alias("at"))),
                F.when(
                    (step < len(steps)) & ~F.coalesce(F.col("after") == step + 1, F.lit(False)),
                    F.struct(F.lit("removed").alias("kind"), (step + 1).alias("at")),
                ),
            )
        )
        met = there.select(*KEYS, F.explode(kinds).alias("c")).select(*KEYS, "c.*")
        values = rows.select(*KEYS, "step", F.struct("key", *names).alias("v")).hint("merge")
        # As a remainder of the condition, so that the buckets of the key serve the join.
        apart = F.col("step") - F.col("at")
        for name, gap, kind in (("old", -1, "added"), ("new", 0, "removed")):
            side = values.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "step", F.col("v").alias(name))
            same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
            met = met.join(side, same & (apart == gap) & (F.col("kind") != kind), "left").drop("_k1", "_k2", "step")
        numbers = [x for i, s in enumerate(steps) for x in (F.lit(i + 1), F.lit(s))]
        put_out = met.select(
            *([F.create_map(*numbers)[F.col("at")].alias(note)] if note else []),
            F.when(F.col("kind") == "removed", F.col("old.key")).otherwise(F.col("new.key")).alias(key),
            F.col("kind").alias("change_kind"),
            *[F.col(f"old.{n}").alias(f"old_{f}") for n, f in zip(names, fields)],
            *[F.col(f"new.{n}").alias(f"new_{f}") for n, f in zip(names, fields)],
        )
        changes, kind_of = index.put_out(put_out), put_out.schema
    last = folders.get(len(steps))
    try:
        index.commit({last: 0} if last else {}, schema, changes, notes, changes_schema=kind_of)
    except Conflict:
        if changes:
            index.files.delete(changes)
        index.refresh()
        return False
    return True


def next_snapshot(
    index: KeyedState, snapshot: DataFrame, key: str, row_id: str, fields: Sequence[str], **notes: int
) -> DataFrame | None:
    """Probe the index of the last snapshot with this one's rows and put out what was added, removed or changed.

    The index is the last snapshot by key, in buckets: the hash of ``fields`` beside the fields themselves, so that a probe
    reads keys and hashes only and old values are fetched for removed and changed rows. Only the new snapshot is shuffled,
    once, and what that writes is the next index. Of rows with the same key the lowest ``row_id`` (an integer) counts. Null
    equals only null in ``fields``; a null key is a key. An empty snapshot removes every key. For the first snapshot nothing
    is put out. Result: the ``notes``, key, change_kind, old_<field>..., new_<field>... If another writer commits first, the
    snapshot is compared with what that one left.
    """
    arrived = _bucketed(index, snapshot, key, row_id, fields)
    while not _steps(index, arrived, [0], key, fields, notes, None):
        if arrived.buckets != index.buckets:
            arrived.close()
            arrived = _bucketed(index, snapshot, key, row_id, fields)
    arrived.close(delete=False)
    types = {n: "int" if -(2**31) <= v < 2**31 else "bigint" for n, v in notes.items()}
    found = index.changes(index.version, types)
    return found and found.select(*notes, *[c for c in found.columns if c not in notes])


def nothing(snapshot: DataFrame, key: str, fields: Sequence[str], notes: dict) -> DataFrame:
    """No changes, with the columns that changes have."""
    return snapshot.limit(0).select(
        *[F.lit(v).alias(k) for k, v in notes.items()],
        key,
        F.lit("").alias("change_kind"),
        *[F.col(f).alias(f"old_{f}") for f in fields],
        *[F.col(f).alias(f"new_{f}") for f in fields],
    )


def changes_between(
    index: KeyedState,
    snapshots: DataFrame,
    snap: str,
    ids: Sequence[int],
    key: str,
    row_id: str,
    fields: Sequence[str],
    at_once: int = SNAPSHOTS_AT_ONCE,
) -> DataFrame | None:
    """``next_snapshot`` over the snapshots ``ids`` in order; those that the index has already seen are left out. All of them
    are read and shuffled once, to their snapshot's part of the buckets; ``at_once`` of them are compared, each with the one
    before, and brought into the index by one commit."""
    done = lambda: index.notes.get(snap)
    todo = [s for s in ids if done() is None or s > done()]
    if todo:
        arrived = _bucketed(index, snapshots.filter(F.col(snap).isin(todo)), key, row_id, fields, snap)
        while some := [s for s in todo if done() is None or s > done()][:at_once]:
            _steps(index, arrived, some, key, fields, {snap: some[-1]}, snap)
        arrived.close(delete=False)
    found = index.changes()
    return found and found.select(snap, *[c for c in found.columns if c != snap])

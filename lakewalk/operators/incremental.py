"""Processing only new or changed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewalk.operators.keyed_state import KEYS, Arrivals, Conflict, KeyedState, content_hash, key_columns

#: A replay brings so many runs into the state's buckets in one pass, and so many of these into the state in one commit.
RUNS_READ, RUNS_AT_ONCE = 64, 8


def process_new(
    state: KeyedState,
    rows: DataFrame,
    key: Sequence[Column],
    content: Sequence[Column],
    rank: Sequence[Column],
    row_id: Column,
    **notes: int,
) -> DataFrame:
    """One run: reduce ``rows`` to one row per key (the greatest ``rank``), compare its hash with the state's, keep what
    is new or different, and commit.

    ``rank`` orders the records of a key, within the rows and against the state, so a record that arrives late doesn't
    undo a newer one.  Its values must be integers and mustn't tie between records of a key (make a unique id the last).

    Puts out ``row_id`` of the new or changed records with the integer ``notes`` as columns, and returns them.  A record
    counts as changed if the key's hash differs from that of the last committed run; a key seen for the first time is
    new.  Null keys and null fields are values like any other; rows repeated exactly are one.  Without rows the run puts
    out nothing and the state stays the same.  If the run dies before its commit, the same run can simply be made again;
    if another writer commits first, it is made again here, upon what that one left.

    Only ``rows`` are shuffled.  A run reads the state's keys, ranks and hashes and writes the records that are newer, not
    the state; now and then the state is folded into one folder.
    """
    hashed = lambda: state.arrive(_hashed(rows, key, content, rank, row_id), _row(len(rank)))
    arrived = hashed()
    while not _advance(state, arrived, [0], len(rank), notes):
        if state.buckets != arrived.buckets:
            arrived.close()
            arrived = hashed()
    arrived.close()
    types = {n: "int" if -(2**31) <= v < 2**31 else "bigint" for n, v in notes.items()}
    return state.changes(state.version, types).filter("changed").select(*notes, "row_id")


def _hashed(rows: DataFrame, key, content, rank, row_id, *more: Column) -> DataFrame:
    ranks = [c.cast("bigint").alias(f"r{i}") for i, c in enumerate(rank)]
    return rows.select(*more, *key_columns(*key), *ranks, content_hash(*content).alias("h"), row_id.alias("row_id"))


def _row(ranks: int) -> Column:
    return F.struct(*[f"r{i}" for i in range(ranks)], "h", "row_id")


def _advance(
    state: KeyedState, arrived: Arrivals, steps: Sequence[int], ranks: int, notes: dict, run_ids: Sequence[int] | None = None
) -> bool:
    """Bring the rows of some consecutive steps into the state by one commit; False if another writer was first, in which
    case nothing was committed. A key has at most one row per step, and each is compared with the greatest before it."""
    row = _row(ranks)
    order = lambda side: F.struct(*[F.col(f"{side}r{i}") for i in range(ranks)])
    best = F.struct(*[f"r{i}" for i in range(ranks)], "h")
    new = arrived.of(*steps)
    if state.version:
        old = state.current()
        if not (len(state.live) == 1 and [*state.live][0].endswith("-base")):
            old = old.groupBy(*KEYS).agg(F.max(row).alias("o")).select(*KEYS, "o.*")
        # Both sides lie in the same buckets: merged where they are, whatever their sizes.
        both = new.join(old.select(*KEYS, best.alias("_old")).hint("merge"), list(KEYS), "left")
    else:
        both = new.withColumn("_old", F.lit(None).cast(new.select(best.alias("o")).schema["o"].dataType))
    if len(steps) > 1:
        earlier = Window.partitionBy(*KEYS).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
        both = both.withColumn("_old", F.greatest("_old", F.max(best).over(earlier)))
    newer = both.filter(F.col("_old").isNull() | (order("") > order("_old.")))
    run = F.lit(None) if run_ids is None else F.create_map(*[F.lit(x) for p in zip(steps, run_ids) for x in p])[F.col("_step")]
    delta = newer.select(
        *KEYS,
        *[f"r{i}" for i in range(ranks)],
        "h",
        "row_id",
        (F.col("_old").isNull() | (F.col("_old.h") != F.col("h"))).alias("changed"),
        run.cast("int").alias("run"),
    )
    folder, n = state.stage(delta)
    try:
        state.commit(state.live | {folder: n}, delta.schema, folder, notes)
    except Conflict:
        state.files.delete(folder)
        state.refresh()
        return False
    if state.fold_is_due:
        # What is folded has been put out before.
        done = [F.lit(False).alias("changed"), F.lit(None).cast("int").alias("run")]
        state.fold(F.struct(*[f"r{i}" for i in range(ranks)], "h", "row_id", *done))
    return True


def replay(
    state: KeyedState,
    feed: DataFrame,
    runs: Sequence[tuple[int, int | None]],
    drop: str,
    key: Sequence[Column],
    content: Sequence[Column],
    rank: Sequence[Column],
    row_id: Column,
    at_once: int = RUNS_AT_ONCE,
) -> DataFrame | None:
    """``process_new`` for every (run id, last drop) in order; each run takes the drops that no run before it has taken.
    Result: run_id, row_id.

    A last drop of None stands for all drops; a run whose last drop isn't above that of its predecessors has nothing to
    take.  Runs that the state already has are left out, so a replay that was cut off goes on where it was, also beside
    another one.  ``at_once`` pending runs are brought into the state together, by one commit, which puts out for each of
    them what it would put out alone.  The feed is read once for each RUNS_READ runs, and its rows are moved once, to the
    run that takes them.
    """
    done = lambda: state.notes.get("run_id")
    todo = [r for r in runs if done() is None or r[0] > done()]
    for first in range(0, len(todo), RUNS_READ):
        some = todo[first : first + RUNS_READ]
        after, step, tops = state.notes.get("last_drop"), F, []
        top = -(2**31) if after is None else after
        for i, (_, last) in enumerate(some):
            top = max(top, 2**31 - 1 if last is None else last)
            step = step.when(F.col(drop) <= top, i)
            tops.append(top)
        rows = feed.filter(F.col(drop) <= top)
        rows = rows if after is None else rows.filter(F.col(drop) > after)
        hashed = _hashed(rows, key, content, rank, row_id, step.alias("step"))
        bring = lambda hashed=hashed: state.arrive(hashed, _row(len(rank)), "step")
        arrived, at = bring(), 0
        while at < len(some):
            if done() is not None and some[at][0] <= done():
                at += 1  # another replay has done it
                continue
            if arrived.buckets != state.buckets:
                arrived.close()
                arrived = bring()
            steps = range(at, min(at + at_once, len(some)))
            ids = [some[i][0] for i in steps]
            if _advance(state, arrived, steps, len(rank), {"run_id": ids[-1], "last_drop": tops[steps[-1]]}, ids):
                at = steps[-1] + 1
        arrived.close()
    found = state.changes()
    return found and found.filter("changed").select(F.col("run").alias("run_id"), "row_id")

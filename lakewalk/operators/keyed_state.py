"""Versioned tables of keys and hashes, bucketed by key, whose versions are put in force one after the other.

Layout below ``root``: ``rows/attempt=<id>`` holds rows that one attempt at a step wrote, bucketed by key;
``changes/attempt=<id>`` what a step put out, where that isn't part of its rows; ``arrivals-<id>`` incoming rows, partitioned by
step and bucketed alike, so that joins with the state move neither side. ``commits/<version>.json`` is the commit: it names the
folders whose rows are the state of that version (a base and the steps since), the bucket count and the caller's notes.

A step writes under names of its own and then makes the file of the next version, which fails if that file is there already
(``Conflict``): of two writers that start from the same version one commits, and the other has to start again from what the
first one left, so no record is lost. What a step that died has written is named by no commit; ``vacuum`` deletes it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lakewalk.storage import Files, configured, observed

KEYS = ("k1", "k2")
#: The state is folded into a new base once there are so many folders, or as many rows in the others as in the base.
MOST_FOLDERS = 8
#: A fold adds buckets beyond so many rows in each.
BUCKET_ROWS = 4_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version that was to be made; nothing was committed."""


def key_columns(*cols: Column) -> list[Column]:
    """A key of 128 bits: two 64-bit hashes over different inputs. Nulls hash as nulls do, so null is a key of its own."""
    flags = [c.isNull() for c in cols]
    return [F.xxhash64(*flags, *cols).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), *flags, *cols).alias("k2")]


def content_hash(*cols: Column) -> Column:
    """64 bits over the fields; which of them are null counts too."""
    return F.xxhash64(*[c.isNull() for c in cols], *cols)


class KeyedState:
    """State of one pipeline. ``buckets`` (default: the session's shuffle partitions) matters for the first version only;
    later ``fold`` sets their number. The folders of the last ``keep`` versions stay readable."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, keep: int = 2):
        self.spark, self.root, self.files, self.keep = spark, root.rstrip("/"), Files(spark), keep
        self._tables: dict[tuple[int, str], tuple[str, set[str]]] = {}
        self._first_buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.refresh()

    # Versions ---------------------------------------------------------------------------------------------------------

    def refresh(self) -> None:
        """Look up the version in force."""
        names = [n for n in self.files.names(f"{self.root}/commits") if n.endswith(".json")]
        self._read = self._record(int(names[-1].removesuffix(".json"))) if names else {}
        self.version, self.notes = self._read.get("version", 0), self._read.get("notes", {})
        self.buckets = self._read.get("buckets", self._first_buckets)

    def _record(self, version: int) -> dict:
        return json.loads(self.files.read_text(f"{self.root}/commits/{version:09d}.json"))

    def commit(
        self,
        live: dict[str, int],
        schema: StructType,
        changes: str | None,
        notes: dict,
        buckets: int | None = None,
        changes_schema: StructType | None = None,
    ) -> None:
        """Put the next version in force: the folders of its rows with their numbers of rows, and the folder of what it puts
        out. One file decides; ``Conflict`` if another writer was first."""
        record = {
            "version": self.version + 1,
            "buckets": buckets or self.buckets,
            "live": live,
            "schema": schema.jsonValue(),
            "changes": changes,
            "changes_schema": (changes_schema or schema).jsonValue(),
            "notes": notes,
        }
        if not self.files.put_new(f"{self.root}/commits/{self.version + 1:09d}.json", json.dumps(record)):
            raise Conflict(f"version {self.version + 1} of {self.root} has been committed by another writer")
        self._read, self.version, self.notes, self.buckets = record, self.version + 1, notes, record["buckets"]
        if self.version > self.keep:
            old = self._record(self.version - self.keep)["live"]
            named: set[str] = set()
            for v in range(self.version - self.keep + 1, self.version + 1):
                named |= {*self._record(v)["live"]}
            for folder in {*old} - named:
                if not self._puts_out(folder):
                    self.files.delete(folder)

    def _puts_out(self, folder: str) -> bool:
        return "/rows/attempt=" in folder and not folder.endswith("-base")

    @property
    def live(self) -> dict[str, int]:
        """The folders of the rows in force, oldest first, with their numbers of rows."""
        return self._read.get("live", {})

    # Rows -------------------------------------------------------------------------------------------------------------

    def current(self) -> DataFrame | None:
        """The rows in force as one bucketed table, so that joins and groupings by the key don't move them. A key has rows
        in each folder that tells of it; None before the first version."""
        return self.opened([*self.live]) if self.version else None

    def opened(self, folders: list[str]) -> DataFrame:
        """The rows of some folders, as one bucketed table."""
        return self._table(folders, StructType.fromJson(self._read["schema"])).drop("_folder")

    def opened_by(self, folders: list[str], schema: StructType, numbers: list[int]) -> DataFrame:
        """The same with the number of each row's folder as ``step``."""
        pairs = [F.lit(x) for f, n in zip(folders, numbers) for x in (_tag(f), n)] or [F.lit(""), F.lit(0)]
        return self._table(folders, schema).withColumn("step", F.create_map(*pairs)[F.col("_folder")]).drop("_folder")

    def _table(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema.add("_folder", StringType()))
        name, known = self._tables.setdefault((self.buckets, schema.json()), (self._name(), set()))
        if not known:
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, _folder string) USING parquet PARTITIONED BY (_folder)"
                f" CLUSTERED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/rows'"
            )
        if new := [f for f in folders if f not in known]:
            parts = " ".join(f"PARTITION (_folder = '{_tag(f)}') LOCATION '{f}'" for f in new)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
            known.update(new)
        return self.spark.table(name).filter(F.col("_folder").isin([_tag(f) for f in folders]))

    def _name(self) -> str:
        return f"lakewalk_{int(time.time())}_{uuid.uuid4().hex}"

    def _save(self, rows: DataFrame, at: str, steps: str | None = None) -> str:
        name = self._name()
        writer = rows.write.format("parquet").bucketBy(self.buckets, *KEYS).option("path", at)
        (writer.partitionBy(steps) if steps else writer).mode("overwrite").saveAsTable(name)
        return name

    def stage(self, rows: DataFrame, base: bool = False) -> tuple[str, int]:
        """Write rows that are partitioned by the key already, such as a join with the state: as they lie, without a shuffle.
        Their folder and number."""
        at = f"{self.root}/rows/attempt={self.version + 1:09d}-{uuid.uuid4().hex}{'-base' * base}"
        seen = Observation()
        self.spark.sql(f"DROP TABLE {self._save(rows.observe(seen, F.count(F.lit(1)).alias('n')), at)}")
        return at, (observed(seen) or {"n": 0})["n"]

    def arrive(self, rows: DataFrame, best: Column, step: str | None = None) -> Arrivals:
        """Incoming rows (KEYS and, for rows of several steps at once, ``step``), reduced to the row of each key (and step)
        whose ``best`` is greatest, in the state's buckets. Combined before the shuffle, so a repeated key isn't a hot one.
        Rows are shuffled here and nowhere else: those of one step once, those of several twice.
        """
        reduced = rows.groupBy(*([step] if step else []), *KEYS).agg(F.max(best).alias("_best"))
        reduced = reduced.select(*([F.col(step).alias("_step")] if step else [F.lit(0).alias("_step")]), *KEYS, "_best.*")
        at = f"{self.root}/arrivals-{uuid.uuid4().hex}"
        if step:
            return Arrivals(self, self._save(reduced.repartition(self.buckets, *KEYS), at, "_step"), at)
        # The grouping's own shuffle puts the rows into the buckets, if it has as many partitions.
        whole = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        with configured(self.spark, **whole):
            return Arrivals(self, self._save(reduced, at, "_step"), at)

    def fold(self, keep_row: Column, buckets: int | None = None) -> None:
        """Put a version in force that is the same state in one folder: of each key the row whose ``keep_row`` is greatest. If
        another writer commits meanwhile, nothing happens; the next fold will do."""
        rows = self.current()
        columns = [c for c in rows.columns if c not in KEYS]
        kept = rows.groupBy(*KEYS).agg(F.max(keep_row).alias("_top")).select(*KEYS, "_top.*").select(*KEYS, *columns)
        wanted = max(buckets or self.buckets, -(-sum(self.live.values()) // BUCKET_ROWS))
        held, self.buckets = self.buckets, wanted
        folder = None
        try:
            folder, n = self.stage(kept.repartition(wanted, *KEYS) if wanted != held else kept, base=True)
            self.commit({folder: n}, rows.schema, None, self.notes, wanted)
        except Conflict:
            self.files.delete(folder)
            self.refresh()
        except BaseException:
            self.buckets = held
            raise

    @property
    def fold_is_due(self) -> bool:
        first, *others = self.live.values() or [0]
        return len(self.live) > MOST_FOLDERS or sum(others) > max(first, BUCKET_ROWS)

    # What steps put out -----------------------------------------------------------------------------------------------

    def changes(self, first: int = 1, names: dict[str, str] | None = None) -> DataFrame | None:
        """What the committed steps from ``first`` on put out, with the notes ``names`` (name to type) as columns."""
        records = [r for v in range(first, self.version + 1) if (r := self._record(v))["changes"]]
        if not records:
            return None
        folders = [r["changes"] for r in records]
        base = folders[0].rsplit("/", 1)[0]
        schema = StructType.fromJson(records[-1]["changes_schema"])
        rows = self.spark.read.option("basePath", base).schema(schema.add("attempt", StringType())).parquet(*folders)
        for name, kind in (names or {}).items():
            pairs = [x for r in records for x in (F.lit(r["changes"].rsplit("=", 1)[1]), F.lit(r["notes"].get(name)).cast(kind))]
            rows = rows.withColumn(name, F.create_map(*pairs)[F.col("attempt")])
        return rows.drop("attempt")

    def put_out(self, changes: DataFrame) -> str:
        """Write what a step puts out; the folder, to be named in its commit with the schema."""
        at = f"{self.root}/changes/attempt={self.version + 1:09d}-{uuid.uuid4().hex}"
        changes.write.parquet(at)
        return at

    # Housekeeping -----------------------------------------------------------------------------------------------------

    def vacuum(self, older_than: float = 7 * 86400) -> list[str]:
        """Delete folders that no commit names and that haven't changed for so many seconds (a step that is still running
        mustn't be older), and drop the session's own names of tables. The folders deleted."""
        records = [self._record(v) for v in range(max(1, self.version - self.keep + 1), self.version + 1)]
        named = {f for r in records for f in r["live"]} | {
            f for v in range(1, self.version + 1) if (f := self._record(v)["changes"])
        }
        gone = []
        for kind in ("rows", "changes"):
            at = f"{self.root}/{kind}"
            gone += [f"{at}/{n}" for n, age in self.files.entries(at) if age >= older_than and f"{at}/{n}" not in named]
        for n, age in self.files.entries(self.root):
            at = f"{self.root}/{n}"
            if n.startswith("arrivals-") and age >= older_than and not any(f.startswith(at + "/") for f in named):
                gone.append(at)
        for at in gone:
            self.files.delete(at)
        for (name,) in [(r["tableName"],) for r in self.spark.sql("SHOW TABLES LIKE 'lakewalk_*'").collect()]:
            if time.time() - int(name.split("_")[1]) >= max(older_than, 1) and name not in {t for t, _ in self._tables.values()}:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return gone

    def close(self) -> None:
        for name, _ in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()


class Arrivals:
    """Incoming rows by step, in the state's buckets."""

    def __init__(self, state: KeyedState, name: str, at: str):
        self.state, self.name, self.at, self.buckets = state, name, at, state.buckets

    def of(self, *steps: int) -> DataFrame:
        """The rows of some steps (``_step``)."""
        return self.state.spark.table(self.name).filter(F.col("_step").isin(*steps))

    def folder(self, step: int = 0) -> str | None:
        """Where the rows of a step lie; None if it has none."""
        at = f"{self.at}/_step={step}"
        return at if self.state.files.exists(at) else None

    def close(self, delete: bool = True) -> None:
        self.state.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if delete:
            self.state.files.delete(self.at)


def _tag(folder: str) -> str:
    return "-".join(folder.rsplit("/", 2)[-2:]).replace("=", "-")

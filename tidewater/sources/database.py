"""Versioned tables on Parquet: a log of commits with snapshot isolation.

A commit is one JSON file in log/, numbered, created only if no other has taken the number. It names
folders of Parquet files that were written before; files that no commit names are not seen, so a writer
that dies leaves nothing behind in any table. Several tables may change in one commit, and a snapshot is
a version of the whole database. A table with a key keeps changes: of each key the row of the last
commit counts, unless it is a deletion.

An index on a column keeps, for each folder, the keys of its rows in the order of the column's values. Nothing is
ever taken out of it: it tells which keys have or once had a value, and the rows themselves are looked at again. A
folder without one, of a commit that came between, makes a lookup read the table until the next compaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import BindingError, ConflictError, ConstraintError, TransactionError
from tidewater.sources.catalog import TableSchema
from tidewater.sources.files import Store
from tidewater.sources.retention import RetentionModel

#: Keys that a commit lists one by one, to tell conflicts; of more it keeps the range, and where ranges meet, the keys in
#: the files are compared.
LISTED_KEYS = 1000
RETRIES = 50
#: Keys that a lookup in an index puts into a condition; beyond them the table is scanned.
LOOKUP_KEYS = 1000
#: Changes are ordered by commit, then by their place in it: commit << PLACES | place.
PLACES = 20


@dataclass
class Change:
    """Rows that a statement writes to a table."""

    table: str
    folder: str
    rows: int
    op: str  # I, U or D
    base: int  # the version that was read
    low: object = None
    high: object = None
    keys: list | None = None
    indexes: dict[str, str] = field(default_factory=dict)  # of each indexed column the folder that holds its values

    def meets(self, other: dict) -> bool | None:
        """Whether both have changed the same row; None if only their files tell."""
        if self.low is None or other["low"] is None:
            return False
        if self.keys is not None and other["keys"] is not None:
            return bool(set(self.keys) & set(other["keys"]))
        return None if self.low <= other["high"] and other["low"] <= self.high else False


@dataclass
class State:
    """What the log holds up to a version."""

    version: int = 0
    tables: dict[str, TableSchema] = field(default_factory=dict)
    folders: dict[str, list[tuple[int, str]]] = field(default_factory=dict)  # with their place in the order of changes
    clean: dict[str, str] = field(default_factory=dict)  # the last compaction's folder: each key once, no deletions
    written: dict[str, int] = field(default_factory=dict)  # rows since the last compaction
    indexed: dict[str, dict[str, str]] = field(default_factory=dict)  # of each folder its columns' index folders

    def copy(self, version: int) -> State:
        indexed = {f: dict(x) for f, x in self.indexed.items()}
        return State(version, dict(self.tables), {t: list(f) for t, f in self.folders.items()}, dict(self.clean), dict(self.written), indexed)


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._entries: dict[int, dict] = {}
        self._last = State()
        self.retention = RetentionModel()

    # log ------------------------------------------------------------------------------------

    def entry(self, version: int) -> dict:
        if version not in self._entries:
            self._entries[version] = json.loads(self.store.text(f"log/{version:010d}.json"))
        return self._entries[version]

    def latest(self) -> int:
        found = [n for n in self.store.names("log") if n.endswith(".json")]
        return int(found[-1][:10]) if found else 0

    def state(self, version: int | None = None, pending: Sequence[Change] = ()) -> State:
        """What the log holds up to a version, and the changes of a transaction on top of it. The log is read on
        from the last state that was asked for."""
        version = self.latest() if version is None else version
        old = self._last
        if old.version > version:
            old = State()
        out = old.copy(version)
        for v in range(old.version + 1, version + 1):
            e = self.entry(v)
            for name, schema in e.get("tables", {}).items():
                out.tables[name] = TableSchema.from_json(schema)
                out.folders.setdefault(name, [])
            for i, c in enumerate(e.get("changes", [])):
                out.folders[c["table"]].append((v << PLACES | i, c["folder"]))
                out.written[c["table"]] = out.written.get(c["table"], 0) + c["rows"]
            for name, (folder, upto, rows) in e.get("compacted", {}).items():
                out.folders[name] = [(((upto + 1) << PLACES) - 1, folder)] + [(w, f) for w, f in out.folders[name] if w >> PLACES > upto]
                out.clean[name], out.written[name] = folder, rows
            for folder, columns in e.get("indexes", {}).items():
                out.indexed.setdefault(folder, {}).update(columns)
        if version > self._last.version:
            self._last = out.copy(version)
        for i, c in enumerate(pending):
            out.folders[c.table].append(((version + 1) << PLACES | i, c.folder))
            out.indexed[c.folder] = c.indexes
        return out

    def _append(self, make: Callable[[State], dict]) -> int:
        """Add the next entry; make is called again where another commit has come first."""
        for _ in range(RETRIES):
            state = self.state()
            entry = make(state)
            if self.store.create(f"log/{state.version + 1:010d}.json", json.dumps(entry, default=str)):
                return state.version + 1
        raise TransactionError("too many other commits at the same time")

    # schemas --------------------------------------------------------------------------------

    def schema(self, table: str, version: int | None = None) -> TableSchema:
        found = self.state(version).tables.get(table.lower())
        if found is None:
            raise BindingError(f"there is no table {table}")
        return found

    def create(self, schema: TableSchema, if_not_exists: bool = False) -> int:
        def make(state: State) -> dict:
            if schema.name in state.tables and not if_not_exists:
                raise BindingError(f"table {schema.name} exists")
            return {"tables": {} if schema.name in state.tables else {schema.name: schema.to_json()}}

        return self._append(make)

    def set_schema(self, change: Callable[[State], TableSchema]) -> int:
        def make(state: State) -> dict:
            s = change(state)
            return {"tables": {s.name: s.to_json()}}

        return self._append(make)

    # indexes --------------------------------------------------------------------------------

    def _sidecar(self, schema: TableSchema, rows: DataFrame, column: str) -> str:
        """Write a column's values with the keys of their rows, in the order of both; a folder."""
        folder = f"index/{schema.name}/x-{uuid.uuid4().hex}"
        entries = rows.select(F.col(column).alias("value"), F.col(schema.key).alias("key")).where("value IS NOT NULL")
        entries.repartitionByRange("value", "key").sortWithinPartitions("value", "key").write.parquet(self.store.full(folder))
        return folder

    def _sidecars(self, schema: TableSchema, rows: DataFrame) -> dict[str, str]:
        return {c: self._sidecar(schema, rows, c) for c in sorted(set(schema.indexes.values())) if schema.indexable(c)}

    def create_index(self, name: str, table: str, column: str) -> int:
        """Index what is written, in one pass, and what will be. On a vector or a table without a key it is a
        name only: these are searched by scans."""
        state = self.state()
        schema = self.schema(table, state.version).with_index(name, column)
        column, made = schema.indexes[name], {}
        missing = [f for _, f in state.folders[schema.name] if column not in state.indexed.get(f, {})]
        if missing and schema.indexable(column):
            folder = self._sidecar(schema, self.spark.read.schema(schema.struct).parquet(*[self.store.full(f) for f in missing]), column)
            made = {f: {column: folder} for f in missing}

        def make(now: State) -> dict:
            return {"tables": {schema.name: now.tables[schema.name].with_index(name, column).to_json()}, "indexes": made}

        return self._append(make)

    def lookup(self, table: str, column: str, condition: str, version: int | None = None, pending: Sequence[Change] = ()) -> list | None:
        """Keys of all rows with, or once with, a `value` of the column that meets a condition. None where no index
        tells, or where it has more than LOOKUP_KEYS entries."""
        state = self.state(version, pending)
        schema = self.schema(table, state.version)
        parts = list(dict.fromkeys(state.indexed.get(f, {}).get(column) for _, f in state.folders[schema.name]))
        if not parts or None in parts:
            return None
        kinds = f"value {schema.column(column).kind}, key {schema.column(schema.key).kind}"
        entries = self.spark.read.schema(kinds).parquet(*[self.store.full(f) for f in parts]).where(condition)
        found = entries.select("key").limit(LOOKUP_KEYS + 1).collect()
        return None if len(found) > LOOKUP_KEYS else sorted({r[0] for r in found})

    # rows -----------------------------------------------------------------------------------

    def _changes(self, table: str, version: int | None = None, pending: Sequence[Change] = ()) -> DataFrame:
        """All rows that commits have written, with _ts (the place in the order of changes) and _op."""
        state = self.state(version, pending)
        schema = self.schema(table, state.version)
        folders = state.folders[schema.name]
        empty = self.spark.createDataFrame([], schema.struct.add("_op", "string").add("_seq", "long"))
        if not folders:
            return empty.withColumn("_ts", F.lit(0))
        rows = self.spark.read.schema(empty.schema).parquet(*[self.store.full(f) for _, f in folders])
        number = F.create_map(*[x for v, f in folders for x in (F.lit(f.rpartition("/")[2]), F.lit(v))])
        return rows.withColumn("_ts", F.element_at(number, F.regexp_extract("_metadata.file_path", r"/(c-[0-9a-f]+)/[^/]+$", 1)))

    def snapshot(self, table: str, version: int | None = None, pending: Sequence[Change] = ()) -> DataFrame:
        """The table's rows as of a version, or as a transaction on it sees them: for each key the last row, unless
        it is deleted. Conditions on the key reach the scan."""
        state = self.state(version, pending)
        schema = self.schema(table, state.version)
        names, folders = [c.name for c in schema.columns], state.folders[schema.name]
        rows = self._changes(table, state.version, pending)
        if schema.key is None or not folders or [f for _, f in folders] == [state.clean.get(schema.name)]:
            return rows.select(*names)
        last = rows.groupBy(schema.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_ts", "_seq", schema.key)]), F.struct("_ts", "_seq")).alias("__r"))
        return last.where("__r._op <> 'D'").select(*[F.col(n) if n == schema.key else F.col("__r")[n].alias(n) for n in names])

    def write(self, table: str, rows: DataFrame, op: str, base: int) -> Change:
        """Put rows into a new folder. Nobody sees them until they are committed."""
        schema = self.schema(table, base)
        folder = f"data/{schema.name}/c-{uuid.uuid4().hex}"
        names = [c.name for c in schema.columns]
        rows = rows.select(*[F.col(c.name).cast(c.type).alias(c.name) for c in schema.columns], F.lit(op).alias("_op"), F.monotonically_increasing_id().alias("_seq"))
        if schema.key and rows.sparkSession.conf.get("spark.sql.shuffle.partitions"):
            rows = rows.sortWithinPartitions(schema.key)  # row groups cover narrow ranges of the key
        rows.write.parquet(self.store.full(folder))
        written = self.spark.read.schema(rows.schema).parquet(self.store.full(folder))
        aggs = [F.count("*").alias("rows")]
        bad: list[Column] = [F.col(c.name).isNull() for c in schema.columns if not c.nullable]
        bad += [F.size(c.name) != c.dimension for c in schema.columns if c.dimension]
        aggs += [F.count_if(b).alias(f"bad{i}") for i, b in enumerate(bad)]
        if schema.key:
            aggs += [F.min(schema.key).alias("low"), F.max(schema.key).alias("high")]
        got = written.agg(*aggs).first()
        if op != "D" and any(got[f"bad{i}"] for i in range(len(bad))):
            self.store.delete(folder)
            wrong = [c.name for c in schema.columns if not c.nullable] + [c.name for c in schema.columns if c.dimension]
            name = next(wrong[i] for i in range(len(bad)) if got[f"bad{i}"])
            raise ConstraintError(f"{table}.{name}: null where none may be, or a vector of another dimension")
        keys = None
        if schema.key and got["rows"] <= LISTED_KEYS:
            keys = [r[0] for r in written.select(schema.key).collect()]
        assert names
        return Change(schema.name, folder, got["rows"], op, base, got["low"] if schema.key else None, got["high"] if schema.key else None, keys, self._sidecars(schema, written))

    def commit(self, changes: list[Change]) -> int:
        """All changes or none. Where a row that was read for a change has been written since, the commit
        that came first stands, and this one fails. Inserts have read nothing."""
        changes = [c for c in changes if c.rows]
        if not changes:
            return self.latest()

        def same_rows(c: Change, o: dict) -> bool:
            if c.table != o["table"] or (meets := c.meets(o)) is False:
                return False
            if meets is None:
                key = self.schema(c.table).key
                mine, theirs = (self.spark.read.parquet(self.store.full(f)).select(key) for f in (c.folder, o["folder"]))
                return not mine.join(theirs, key, "left_semi").isEmpty()
            return True

        def make(state: State) -> dict:
            for c in changes:
                for v in range(c.base + 1, state.version + 1):
                    if c.op != "I" and any(same_rows(c, o) for o in self.entry(v).get("changes", [])):
                        raise ConflictError(f"{c.table}: commit {v} has changed the same rows")
            return {"changes": [{"table": c.table, "folder": c.folder, "rows": c.rows, "op": c.op, "low": c.low, "high": c.high, "keys": c.keys} for c in changes], "indexes": {c.folder: c.indexes for c in changes if c.indexes}}

        return self._append(make)

    # maintenance ----------------------------------------------------------------------------

    def dead_versions(self, table: str) -> int:
        """Rows written that no snapshot of now shows."""
        rows = self._changes(table)
        return rows.count() - self.snapshot(table).count()

    def compact(self, table: str) -> int:
        """Write the table's rows anew, as one folder; older commits' files are no longer read."""
        state = self.state()
        schema = self.schema(table, state.version)
        rows = self.snapshot(table, state.version).withColumn("_op", F.lit("I")).withColumn("_seq", F.lit(0).cast("long"))
        folder = f"data/{schema.name}/c-{uuid.uuid4().hex}"
        if schema.key:
            rows = rows.repartitionByRange(F.col(schema.key)).sortWithinPartitions(schema.key)
        rows.write.parquet(self.store.full(folder))
        compacted = self.spark.read.schema(schema.struct).parquet(self.store.full(folder))
        n, indexes = compacted.count(), self._sidecars(schema, compacted)
        upto = state.version

        def make(now: State) -> dict:
            if any(table in self.entry(v).get("compacted", {}) for v in range(upto + 1, now.version + 1)):
                raise ConflictError(f"{table} has been compacted meanwhile")
            return {"compacted": {schema.name: [folder, upto, n]}, "indexes": {folder: indexes} if indexes else {}}

        return self._append(make)

    def maybe_compact(self, table: str) -> bool:
        """Compact where the retention model predicts enough dead versions."""
        written = self.state().written.get(table.lower(), 0)
        if not self.retention.due(table, written):
            return False
        self.retention.observe(table, written, self.dead_versions(table))
        if self.retention.predict(written) < self.retention.threshold:
            return False
        self.compact(table)
        return True

    def vacuum(self, horizon: int | None = None) -> int:
        """Delete folders that no entry of the log names, of writers that died. Not while others write. With a
        horizon, also those that no snapshot from that version on reads; older snapshots can't be read then."""
        latest = self.latest()
        first = 1 if horizon is None else min(horizon, latest) + 1
        named = set() if horizon is None else {f for folders in self.state(first - 1).folders.values() for _, f in folders}
        named |= {c["folder"] for v in range(first, latest + 1) for c in self.entry(v).get("changes", [])}
        named |= {f for v in range(first, latest + 1) for f, _, _ in self.entry(v).get("compacted", {}).values()}
        gone = 0
        for table in self.store.names("data"):
            for name in self.store.names(f"data/{table}"):
                if f"data/{table}/{name}" not in named:
                    self.store.delete(f"data/{table}/{name}")
                    gone += 1
        # an index folder goes with the last folder whose values it holds
        used = {x for f, columns in self.state(latest).indexed.items() if f in named for x in columns.values()}
        for table in self.store.names("index"):
            for name in self.store.names(f"index/{table}"):
                if f"index/{table}/{name}" not in used:
                    self.store.delete(f"index/{table}/{name}")
        return gone

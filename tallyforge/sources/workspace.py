"""Workspaces as versioned Parquet: what a revision points to is never changed, and a commit writes the rows of its own accounts only.

Rows lie at data/<table>/store_ver=<version>/store_acct=<account>, as they were given, account_id with its type. A revision is one small file, _committed/<revision>:
the tables with their schemas, a map (Parquet: account -> version, revision of the account), and the accounts that changed since that map. The file is written aside in
full and then published by a rename that doesn't overwrite, so readers see a revision whole or not at all, and of several writers of a revision one wins (atomic where the
file system's rename is, as on HDFS). Markers that hold no revision, as crashes of other tools may leave, count as absent and are moved to _corrupt by the next commit.

Accounts have revisions of their own: writers of different accounts don't disturb each other, and `commit_account` is refused only if its own account has moved on.
A null account_id is an account. The map is written anew when more than MOST_CHANGES accounts have changed since it; no step copies other accounts' rows.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyforge.operators.inventory import newest

MOST_CHANGES = 1000
POINTS = "restore_points"
BATCHES = "saved_batches"
_EVERY = object()
_POINT = "restore_point_id string, reason string, created_at string, account_revision long, version string"
_MAP = "store_acct string, store_ver string, account_revision long"
_PLACE = StructType([StructField("store_ver", StringType()), StructField("store_acct", StringType())])


class StaleRevision(RuntimeError):
    pass


def _key(account: object) -> str:
    return "n" if account is None else "a" + hashlib.sha256(str(account).encode()).hexdigest()


def _key_of(account: Column) -> Column:
    return F.coalesce(F.concat(F.lit("a"), F.sha2(F.encode(account.cast("string"), "utf-8"), 256)), F.lit("n"))


@dataclass(frozen=True)
class _State:
    """What a revision's file says; changes: account key -> (version or None, revision of the account)."""

    tables: dict[str, str] = field(default_factory=dict)
    map: str | None = None
    changes: dict[str, tuple[str | None, int]] = field(default_factory=dict)


class Workspace:
    """Tables of one store, each with a column account_id."""

    SCHEMA = 2

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # revisions

    def _names(self, folder: str) -> list[str]:
        p = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def _read(self, revision: int) -> _State | None:
        """None if the marker isn't there or holds no revision; a ValueError if it is of another schema version."""
        p = self.path(f"{self.root}/_committed/{revision}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        finally:
            stream.close()
        try:
            got = json.loads(text)
            version = got["schema"]
        except (ValueError, KeyError, TypeError):
            return None
        if version != self.SCHEMA:
            raise ValueError(f"schema version {version}, expected {self.SCHEMA}")
        return _State(got["tables"], got["map"], {k: tuple(v) for k, v in got["changes"].items()})

    def revisions(self) -> list[int]:
        return sorted(r for r in (int(n) for n in self._names("_committed") if n.isdigit()) if self._read(r) is not None)

    def revision(self) -> int:
        """The newest; 0 before the first commit."""
        return next((r for r in sorted((int(n) for n in self._names("_committed") if n.isdigit()), reverse=True) if self._read(r) is not None), 0)

    def _state(self, revision: int | None = None) -> _State:
        revision = self.revision() if revision is None else revision
        state = self._read(revision) if revision else _State()
        if state is None:
            raise StaleRevision(f"revision {revision} isn't there")
        return state

    def _publish(self, revision: int, state: _State) -> None:
        aside, marker = self.path(f"{self.root}/_aside/{uuid.uuid4().hex}"), self.path(f"{self.root}/_committed/{revision}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": self.SCHEMA, "tables": state.tables, "map": state.map, "changes": state.changes}).encode()))
        out.close()
        if self.fs.exists(marker) and self._read(revision) is None:
            self.fs.mkdirs(self.path(f"{self.root}/_corrupt"))
            self.fs.rename(marker, self.path(f"{self.root}/_corrupt/{revision}-{uuid.uuid4().hex}"))
        self.fs.mkdirs(marker.getParent())
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, marker, how)
        except Exception as e:
            self.fs.delete(aside, False)
            raise StaleRevision(f"revision {revision} was committed by another writer") from e

    # writing

    def _write(self, tables: dict[str, DataFrame]) -> str:
        """The rows as a new version, which no revision points to yet."""
        version = uuid.uuid4().hex
        for name, t in tables.items():
            t.withColumn("store_acct", _key_of(F.col("account_id"))).write.partitionBy("store_acct").parquet(f"{self.root}/data/{name}/store_ver={version}")
        return version

    def _map(self, live: DataFrame) -> str:
        name = uuid.uuid4().hex
        live.select("store_acct", "store_ver", "account_revision").write.parquet(f"{self.root}/maps/{name}")
        return name

    def commit(self, expected: int, tables: dict[str, DataFrame]) -> int:
        """Write all tables of all accounts as revision `expected` + 1; refused if another commit came first."""
        if self.revision() != expected:
            raise StaleRevision(f"expected {expected}, found {self.revision()}")
        version = self._write(tables)
        schemas = {n: t.schema.json() for n, t in tables.items()}
        accounts = None
        for t in tables.values():
            own = t.select(_key_of(F.col("account_id")).alias("store_acct"))
            accounts = own if accounts is None else accounts.unionByName(own)
        accounts = self.spark.createDataFrame([], "store_acct string") if accounts is None else accounts
        before = self._live(self._state(expected)).select("store_acct", F.col("account_revision").alias("r"))
        live = accounts.distinct().join(before, "store_acct", "left").select("store_acct", F.lit(version).alias("store_ver"), (F.coalesce("r", F.lit(0)) + 1).alias("account_revision"))
        self._publish(expected + 1, _State(schemas, self._map(live)))
        return expected + 1

    def _change(self, expected: int, state: _State, account: object, version: str | None, schemas: dict[str, str]) -> int:
        changes = state.changes | {_key(account): (version, self._account(state, account)[1] + 1)}
        state = replace(state, tables=state.tables | schemas, changes=changes)
        if len(changes) > MOST_CHANGES:
            # accounts that went leave the map
            state = replace(state, map=self._map(self._live(state)), changes={})
        self._publish(expected + 1, state)
        return expected + 1

    def _rows_of(self, state: _State, account: object, tables: dict[str, DataFrame]) -> tuple[str, dict[str, str], dict[str, int]]:
        """An account's rows as a new version, with schemas and counts; refused if they are other accounts' rows or of another schema."""
        for n, t in tables.items():
            if n in state.tables and state.tables[n] != t.schema.json() and {(f.name, f.dataType) for f in t.schema} != {(f.name, f.dataType) for f in StructType.fromJson(json.loads(state.tables[n]))}:
                raise ValueError(f"{n} has another schema than before")
        count = {n: t.agg(F.count("*"), F.count(F.when(~F.col("account_id").cast("string").eqNullSafe(F.lit(None if account is None else str(account))), 1))).first() for n, t in tables.items()}
        if other := [n for n, c in count.items() if c[1]]:
            raise ValueError(f"rows of other accounts in {', '.join(other)}")
        return self._write(tables), {n: t.schema.json() for n, t in tables.items() if n not in state.tables}, {n: c[0] for n, c in count.items()}

    def replace_account(self, expected: int, account: object, tables: dict[str, DataFrame]) -> int:
        """Commit an account's tables in place of all it had, as revision `expected` + 1 of the store; the revision before stays as the restore point, and the result is read back."""
        if self.revision() != expected:
            raise StaleRevision(f"expected {expected}, found {self.revision()}")
        state = self._state(expected)
        version, schemas, want = self._rows_of(state, account, tables)
        done = self._change(expected, state, account, version, schemas)
        for n, k in want.items():
            if self.table(n, account, done).count() != k:
                raise RuntimeError(f"{n} has not {k} rows after the commit")
        return done

    def commit_account(self, account: object, expected: int, tables: dict[str, DataFrame], restore_point: dict[str, str] | None = None, keep: int = 3) -> int:
        """Commit an account's tables as its own revision `expected` + 1, which is returned; refused if the account isn't at `expected`.

        Other accounts' commits in between only repeat the last small step. Tables that aren't given stay as they are. A restore point (restore_point_id, reason,
        created_at) keeps what the account had before, of which the newest `keep` stay; it needs an account that is there.
        """
        state = self._state()
        version, was = self._account(state, account)
        if was != expected:
            raise StaleRevision(f"account {account!r}: expected {expected}, found {was}")
        if restore_point and version is None:
            raise ValueError("a restore point needs an account that is there")
        tables = dict(tables)
        points = self.points(account)
        if restore_point:
            one = [(restore_point["restore_point_id"], restore_point["reason"], restore_point["created_at"], was, version)]
            every = points.drop("account_id").unionByName(self.spark.createDataFrame(one, _POINT))
            points = every.orderBy(F.desc("created_at"), F.desc("restore_point_id")).limit(keep)
        if restore_point or version is not None and POINTS in state.tables:
            tables[POINTS] = points.select(F.lit(None if account is None else str(account)).cast("string").alias("account_id"), *[c for c in points.columns if c != "account_id"])
        for n in state.tables:
            if n not in tables:
                tables[n] = self.table(n, account)
        new, schemas, _ = self._rows_of(state, account, tables)
        return self._publish_account(account, expected, new, schemas)

    def _publish_account(self, account: object, expected: int, version: str | None, schemas: dict[str, str]) -> int:
        while True:
            revision = self.revision()
            state = self._state(revision)
            if self._account(state, account)[1] != expected:
                raise StaleRevision(f"account {account!r}: expected {expected}, found {self._account(state, account)[1]}")
            try:
                self._change(revision, state, account, version, {n: s for n, s in schemas.items() if n not in state.tables})
                return expected + 1
            except StaleRevision:
                if self.revision() == revision:  # not another commit, so trying again is no use
                    raise

    def commit_accounts(self, tables: Callable[[], dict[str, DataFrame]], source: str | None = None, batch: int | None = None) -> int:
        """Commit many accounts' rows as one revision of the store: of every account that occurs in `tables`, the tables given are replaced and the others stay.

        tables is asked anew when another commit comes in between, so it may depend on what the store has. With a source and a batch number, accounts
        that already took that batch, or a later one, of the source are left out: a batch that is run again commits nothing twice. The keys of the accounts of
        one such commit pass through the driver while they are MOST_CHANGES or fewer; more are merged into the map as a table.
        """
        while True:
            now = self.revision()
            state, given = self._state(now), tables()
            keys = None
            for t in given.values():
                own = t.select(_key_of(F.col("account_id")).alias("store_acct"), F.col("account_id").cast("string").alias("account_id"))
                keys = own if keys is None else keys.unionByName(own)
            keys = keys.distinct()
            if source is not None:
                if BATCHES in state.tables:
                    saved = self.table(BATCHES, revision=now).where((F.col("source") == source) & (F.col("batch") >= batch))
                    keys = keys.join(saved.select(_key_of(F.col("account_id")).alias("store_acct")), "store_acct", "left_anti")
                mark = keys.select("account_id", F.lit(source).alias("source"), F.lit(batch).cast("long").alias("batch"))
                if BATCHES in state.tables:
                    mark = mark.unionByName(self._of(self.table(BATCHES, revision=now), keys).where(F.col("source") != source))
                given = given | {BATCHES: mark}
            keys = keys.select("store_acct")
            few = keys.limit(MOST_CHANGES + 1).collect()
            if not few:
                return now
            rows = {n: self._of(t, keys) for n, t in given.items()} | {n: self._of(self.table(n, revision=now), keys) for n in state.tables if n not in given}
            version = self._write(rows)
            revisions = self._live(state).select("store_acct", "account_revision")
            schemas = {n: t.schema.json() for n, t in given.items() if n not in state.tables}
            after = keys.join(revisions, "store_acct", "left").select("store_acct", F.lit(version).alias("store_ver"), (F.coalesce("account_revision", F.lit(0)) + 1).alias("account_revision"))
            if len(few) + len(state.changes) <= MOST_CHANGES:
                changed = replace(state, tables=state.tables | schemas, changes=state.changes | {r.store_acct: (r.store_ver, r.account_revision) for r in after.collect()})
            else:
                rest = self._live(state).join(keys, "store_acct", "left_anti")
                changed = _State(state.tables | schemas, self._map(rest.unionByName(after)), {})
            try:
                self._publish(now + 1, changed)
                return now + 1
            except StaleRevision:
                if self.revision() == now:
                    raise

    def _of(self, t: DataFrame, keys: DataFrame) -> DataFrame:
        return t.withColumn("store_acct", _key_of(F.col("account_id"))).join(keys.select("store_acct"), "store_acct", "left_semi").drop("store_acct")

    def delete_account(self, account: object) -> int:
        """Cascade: every table without the account's rows, as a new revision of the store."""
        now = self.revision()
        return self._change(now, self._state(now), account, None, {})

    def restore(self, revision: int) -> int:
        """An earlier revision as a new one, checked by reading it first; it points to the same files, so nothing is copied."""
        state = self._state(revision)
        for n in state.tables:
            self.table(n, revision=revision).count()
        now = self.revision()
        self._publish(now + 1, state)
        return now + 1

    def restore_account(self, account: object, restore_point_id: str, expected: int) -> int:
        """What an account had at one of its restore points, as its revision `expected` + 1; its list of restore points stays."""
        point = self.points(account).where(F.col("restore_point_id") == restore_point_id).first()
        if point is None:
            raise ValueError(f"no restore point {restore_point_id!r}")
        state = self._state()
        tables = {n: self._rows(n, state, point.version, account) for n in state.tables if n != POINTS}
        return self.commit_account(account, expected, tables)

    # reading

    def _live(self, state: _State) -> DataFrame:
        """store_acct, store_ver, account_revision of the accounts that are there."""
        base = self.spark.read.schema(_MAP).parquet(f"{self.root}/maps/{state.map}") if state.map else self.spark.createDataFrame([], _MAP)
        changed = self.spark.createDataFrame([(k, *v) for k, v in state.changes.items()], _MAP)
        return base.join(changed.select("store_acct"), "store_acct", "left_anti").unionByName(changed.where("store_ver is not null"))

    def _account(self, state: _State, account: object) -> tuple[str | None, int]:
        """Version and revision of an account; (None, 0) if it never was."""
        key = _key(account)
        if key in state.changes:
            return state.changes[key]
        row = self.spark.read.schema(_MAP).parquet(f"{self.root}/maps/{state.map}").where(F.col("store_acct") == key).first() if state.map else None
        return (row.store_ver, row.account_revision) if row else (None, 0)

    def account_revision(self, account: object) -> int:
        return self._account(self._state(), account)[1]

    def _rows(self, name: str, state: _State, version: str | None, account: object) -> DataFrame:
        schema = StructType.fromJson(json.loads(state.tables[name]))
        folder = f"{self.root}/data/{name}/store_ver={version}/store_acct={_key(account)}"
        if version is None or not self.fs.exists(self.path(folder)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def table(self, name: str, account: object = _EVERY, revision: int | None = None) -> DataFrame:
        """A table of a revision (the newest by default), as it was given. With an account only that account's folder is read; None is the account of null."""
        state = self._state(revision)
        if name not in state.tables:
            raise ValueError(f"there is no table {name}")
        if account is not _EVERY:
            return self._rows(name, state, self._account(state, account)[0], account)
        schema, folder = StructType.fromJson(json.loads(state.tables[name])), f"{self.root}/data/{name}"
        if not self.fs.exists(self.path(folder)):
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(StructType(schema.fields + _PLACE.fields)).parquet(folder)
        return every.join(self._live(state), ["store_ver", "store_acct"], "left_semi").select(*schema.names)

    def tables(self, revision: int | None = None) -> list[str]:
        return sorted(self._state(revision).tables)

    def points(self, account: object) -> DataFrame:
        """An account's restore points, newest first."""
        state = self._state()
        if POINTS not in state.tables:
            return self.spark.createDataFrame([], f"account_id string, {_POINT}")
        return self.table(POINTS, account).orderBy(F.desc("created_at"), F.desc("restore_point_id"))

    # upkeep

    def _files(self) -> DataFrame:
        """name, store_ver, store_acct, path, length, modificationTime of all data files; their content isn't read."""
        folder = f"{self.root}/data"
        if not self.fs.exists(self.path(folder)):
            return self.spark.createDataFrame([], "name string, store_ver string, store_acct string, path string, length long, modificationTime timestamp")
        f = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
        part = lambda p: F.regexp_extract("path", rf"/data/([^/]*)/store_ver=([^/]*)/store_acct=([^/]*)/", p)
        return f.select(part(1).alias("name"), part(2).alias("store_ver"), part(3).alias("store_acct"), "path", "length", "modificationTime")

    def restore_points(self, keep: int = 3) -> DataFrame:
        """(revision, bytes, files) of the newest `keep`, newest first."""
        out = self.spark.createDataFrame([], "revision long, bytes long, files long")
        for r in self.revisions()[::-1][:keep]:
            own = self._files().join(self._live(self._state(r)), ["store_ver", "store_acct"], "left_semi")
            out = out.unionByName(own.agg(F.lit(r).cast("long").alias("revision"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files")))
        return out.orderBy(F.desc("revision"))

    def storage_bytes(self) -> int:
        return self.fs.getContentSummary(self.path(self.root)).getLength()

    def prune(self, keep: int = 3, grace: float = 3600.0) -> list[int]:
        """Drop all but the newest `keep` revisions, then the files that no revision kept, nor a restore point in it, points to.

        Files younger than `grace` seconds stay, as a commit may be about to publish them.
        """
        every = self.revisions()
        gone, kept = every[: -keep or None], every[len(every) - keep if keep else len(every) :]
        live = None
        for r in kept:
            state = self._state(r)
            own = self._live(state).select("store_acct", "store_ver")
            if POINTS in state.tables:
                own = own.unionByName(self.table(POINTS, revision=r).select(_key_of(F.col("account_id")).alias("store_acct"), F.col("version").alias("store_ver")))
            live = own if live is None else live.unionByName(own)
        for r in gone:
            self.fs.delete(self.path(f"{self.root}/_committed/{r}"), False)
        maps = {self._state(r).map for r in kept}
        for n in self._names("maps"):
            if n not in maps and self._old(f"{self.root}/maps/{n}", grace):
                self.fs.delete(self.path(f"{self.root}/maps/{n}"), True)
        files = self._files().where(F.col("modificationTime") <= F.timestamp_seconds(F.lit(time.time() - grace)))
        dead = files if live is None else files.join(live.distinct(), ["store_ver", "store_acct"], "left_anti")
        for row in dead.select("path").toLocalIterator():
            self.fs.delete(self.path(row.path), False)
        return gone

    def _old(self, path: str, grace: float) -> bool:
        return self.fs.getFileStatus(self.path(path)).getModificationTime() / 1000 <= time.time() - grace


def image_files(images: DataFrame, folder: str) -> DataFrame:
    """images (id, stored_path, ...) with `missing`: no file of that path lies below the folder. Paths that lead out of it are missing."""
    spark = images.sparkSession
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    own = there.select(F.expr(f"substring(path, {len(base) + 2})").alias("stored_path"), F.lit(True).alias("_there"))
    return images.join(own, "stored_path", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def delete_orphans(spark: SparkSession, folder: str, referenced: DataFrame) -> list[str]:
    """Delete the files below a folder that no `path` refers to; returns their paths, relative to it. Files that are being written (.tmp) stay."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(base).toString()
    files = every.select(F.expr(f"substring(path, {len(root) + 2})").alias("path")).where(~F.endswith("path", F.lit(".tmp")))
    gone = [r.path for r in orphans(files, referenced).toLocalIterator()]
    for p in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}"), False)
    return sorted(gone)


def accounts(table: DataFrame) -> DataFrame:
    """Accounts with their place by creation, then id."""
    from tallyforge.operators.inventory import numbered

    return numbered(table.select("account_id", "created_at").distinct(), [F.asc("created_at"), F.asc("account_id")], "pos")


def retained(points: DataFrame, companions: dict[str, DataFrame], n: int = 3) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The newest n restore points per account, and companion tables without the rows of those that went."""
    kept = newest(points, "account_id", ["created_at", "restore_point_id"], n)
    keys = kept.select("restore_point_id")
    return kept, {k: t.join(keys, "restore_point_id", "left_semi") for k, t in companions.items()}


def draft_faults(order: DataFrame, metadata: DataFrame) -> DataFrame:
    """(draft, image, fault): images listed twice, without metadata, or with metadata but not listed."""
    o = order.groupBy("draft", "image").agg(F.count("*").alias("_n"))
    m = metadata.select("draft", "image", F.lit(True).alias("_m")).distinct()
    x = o.join(m, ["draft", "image"], "full_outer")
    fault = F.when(F.col("_n").isNull(), "not_listed").when(F.col("_m").isNull(), "no_metadata").when(F.col("_n") > 1, "listed_twice")
    return x.select("draft", "image", fault.alias("fault")).where("fault is not null")


def orphans(files: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files that nothing refers to."""
    return files.join(referenced.select("path").distinct(), "path", "left_anti")

"""A warehouse of snapshots: tables of chunks, entries and snapshots, with driver-side pointers and logs.

    chunks/prefix=xx/     hash, length, data: inserted once, never changed
    entries/snapshot_id=/ pos, path, mode, size, mtime_secs, mtime_nanos, content, chunks
    snapshots/            snapshot_id, parent_id, version, timestamp_secs, message, actor, unstable, n
    HEAD, remotes/        pointer files, swapped by rename
    audit.jsonl, tombstones.jsonl, anchors/, fleet.pub, last_order, warehouse_id

The three tables lie beside the pointers or, if ``init`` is given a URI, in a folder of
any file system that Spark reads; on a cluster it must be one that all executors share.
The worktree itself is read and written by paths, on a disk that the executors see.

One writer at a time holds the lock. Tables take new files only; what counts is what the
pointers reach, so a writer that dies half-way leaves unreferenced rows. A purge replaces
whole folders of chunks by a journal, which the next writer ends if its own died. A
snapshot's id hashes its header and entries alone, so a reader can compute it again.
"""

from __future__ import annotations

import contextlib
import dataclasses
import fcntl
import hashlib
import json
import os
import secrets
import subprocess
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars, signing
from tidemark.functions.hashing import fan_out, json_text
from tidemark.operators import chains, chunks, diff, history, ordering, purge, replication, undo
from tidemark.sources.shared import stored
from tidemark.sources.worktree import hash_file, read_worktree

STORE = ".tidemark"
VERSION, VERSIONS = 3, (2, 3)
MOST_FILES, MOST_CHUNKS = 2_000_000, 8_000_000
IGNORE_FILE = ".tidemarkignore"
#: How often a file is read that changes meanwhile.
READS = 4
CHUNKS = "hash string, length int, data binary, prefix string"
ENTRIES = "pos long, path string, mode int, size long, mtime_secs long, mtime_nanos int, content string, chunks array<string>, snapshot_id string"
SNAPSHOTS = "snapshot_id string, parent_id string, version int, timestamp_secs long, message string, actor string, unstable array<string>, n long"
AUDIT = "seq long, ts long, event string, detail string, prev string, hash string"
TOMBSTONES = "path string, content string, purge_id string, ts long"
CERTIFICATE, ANCHOR, ORDER = "tidemark-purge/v1", "tidemark-anchor/v1", "tidemark-order/v1"


class WarehouseError(Exception):
    """Anything that a warehouse refuses."""


class Locked(WarehouseError):
    """Another writer holds the lock."""


class Corrupt(WarehouseError):
    """Stored or given data that don't fit their hashes or constraints."""


class MissingObject(WarehouseError):
    """A snapshot or chunk that isn't there."""


class Dirty(WarehouseError):
    """Changes that no snapshot has would be lost."""


class Purged(WarehouseError):
    """A path or content that a tombstone names."""


@dataclasses.dataclass
class GuardReport:
    snapshot: str
    exit_code: int | None
    signal: int | None
    drift: list[tuple[str, str]]
    reverted: bool

    def process_exit_code(self) -> int:
        return self.exit_code if self.exit_code is not None else 128 + self.signal if self.signal is not None else 1


def snapshot_ids(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """(snapshot_id, id): the id that each snapshot's header and entries give, group by group of paths."""
    body = F.to_json(F.struct("path", "mode", "size", "mtime_secs", "mtime_nanos", "content", "chunks"))
    hashed = entries.select("snapshot_id", F.substring(F.sha2("path", 256), 1, 2).alias("g"), body.alias("body"))
    groups = hashed.groupBy("snapshot_id", "g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("body")), "\n"), 256).alias("h"))
    roots = groups.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "").alias("root"))
    header = F.to_json(F.struct("version", "parent_id", "timestamp_secs", "message", "actor", F.array_sort("unstable").alias("unstable")), {"ignoreNullFields": "false"})
    return snapshots.join(roots, "snapshot_id", "left").select("snapshot_id", F.sha2(F.concat_ws("\n", header, "root"), 256).alias("id"))


def atomic_write(path: str, text: str) -> None:
    tmp = f"{path}.{secrets.token_hex(8)}.tmp"
    with os.fdopen(os.open(tmp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644), "w") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(tmp, path)


def find_root(start: str) -> str:
    """The nearest directory at or above start that holds a store."""
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, STORE, "snapshots")):
        if os.path.dirname(at) == at:
            raise WarehouseError(f"no store at or above {start}")
        at = os.path.dirname(at)
    return at


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.path = spark, os.path.abspath(root), os.path.join(os.path.abspath(root), STORE)

    @classmethod
    def init(cls, spark: SparkSession, root: str, tables: str | None = None) -> Warehouse:
        """Make the layout where it is missing; harmless when repeated. tables: URI of a folder for the tables."""
        w = cls(spark, root)
        fresh = not os.path.exists(w._at("HEAD"))
        for d in ("chunks", "entries", "snapshots", "remotes", "anchors"):
            os.makedirs(w._at(d), exist_ok=True)
        if fresh:
            if tables:
                atomic_write(w._at("tables"), tables.rstrip("/"))
            atomic_write(w._at("HEAD"), "")
            atomic_write(w._at("warehouse_id"), secrets.token_hex(32))
            w.record("init", w.root)
        return w

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _uri(self, *parts: str) -> str:
        """A place among the tables."""
        base = f"file://{self.path}"
        with contextlib.suppress(FileNotFoundError), open(self._at("tables")) as file:
            base = file.read().strip()
        return "/".join([base, *parts])

    def _fs(self, uri: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _table(self, name: str, schema: str) -> DataFrame:
        fs, path = self._fs(self._uri(name))
        if not fs.exists(path) or not any(not s.getPath().getName().startswith((".", "_")) for s in fs.listStatus(path)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._uri(name))

    def _append(self, rows: DataFrame, name: str, *partitions: str) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy(*partitions).parquet(self._uri(name))

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOTS)

    def entries(self, snapshot_id: str | None = None) -> DataFrame:
        every = self._table("entries", ENTRIES)
        return every if snapshot_id is None else every.where(F.col("snapshot_id") == snapshot_id)

    @contextlib.contextmanager
    def lock(self):
        with open(self._at("lock"), "w") as file:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise Locked("another writer is at work") from e
            self._end_sweep()
            yield

    # --- pointers and logs ---

    def head(self) -> str | None:
        with contextlib.suppress(FileNotFoundError), open(self._at("HEAD")) as file:
            return file.read().strip() or None

    def set_head(self, snapshot_id: str) -> None:
        atomic_write(self._at("HEAD"), snapshot_id)

    def resolve(self, reference: str) -> str:
        return history.resolve(self.snapshots(), reference, self.head())

    def record(self, event: str, detail: str) -> None:
        """Append to the audit log; seq and prev follow its last readable line."""
        seq, prev = 0, ""
        with contextlib.suppress(FileNotFoundError), open(self._at("audit.jsonl"), encoding="utf-8") as file:
            for line in file:
                with contextlib.suppress(ValueError, KeyError, TypeError):
                    entry = json.loads(line)
                    seq, prev = entry["seq"] + 1, entry["hash"]
        ts = int(time.time())
        body = f"[{seq},{ts},{json_text(event)},{json_text(detail)},{json_text(prev)}]"
        entry = {"seq": seq, "ts": ts, "event": event, "detail": detail, "prev": prev, "hash": hashlib.sha256(body.encode()).hexdigest()}
        with open(self._at("audit.jsonl"), "a", encoding="utf-8") as file:
            file.write("{" + ",".join(f"{json_text(k)}:{v if isinstance(v, int) else json_text(v)}" for k, v in entry.items()) + "}\n")

    def _lines(self, name: str, schema: str) -> DataFrame:
        """JSON lines with their numbers, blank ones left out; line_no counts as written."""
        if not os.path.exists(self._at(name)):
            return self.spark.createDataFrame([], f"line_no long, raw string, {schema}")
        # a file's lines in order of its splits and of lines in a split
        lines = self.spark.read.option("lineSep", "\n").text(f"file://{self._at(name)}").select(F.col("value").alias("raw"), "_metadata.file_block_start")
        rows = ordering.numbered(lines, "file_block_start", name="line_no", stable=True).where(F.trim("raw") != "")
        return rows.select("line_no", "raw", F.from_json("raw", schema).alias("j")).select("line_no", "raw", "j.*")

    def audit(self) -> DataFrame:
        return self._lines("audit.jsonl", AUDIT)

    def tombstones(self) -> DataFrame:
        rows = self._lines("tombstones.jsonl", TOMBSTONES)
        bad = rows.where("path IS NULL OR content IS NULL").select("line_no").first()
        if bad:
            raise Corrupt(f"tombstone line {bad[0] + 1}")
        return rows.select("path", "content", "purge_id", "ts")

    # --- snapshots ---

    def ignore_patterns(self) -> list[str]:
        with contextlib.suppress(FileNotFoundError), open(os.path.join(self.root, IGNORE_FILE), encoding="utf-8") as file:
            return scalars.ignore_patterns(file.read().splitlines())
        return []

    def live(self, ignore: bool = True) -> DataFrame:
        """The worktree without excluded and ignored paths, contents not read."""
        files = read_worktree(self.spark, self.root).where(~scalars.excluded(F.col("path")))
        return files.where(~scalars.ignored(F.col("path"), self.ignore_patterns())) if ignore else files

    def hashed(self, files: DataFrame) -> DataFrame:
        """files with the hash of each regular file's bytes."""
        root = self.root
        @F.pandas_udf("string")
        def hash_of(paths, kinds):
            import pandas as pd

            return pd.Series([hash_file(os.path.join(root, p)) if k == "file" else None for p, k in zip(paths, kinds, strict=True)], dtype=object)

        return files.withColumn("content", hash_of("path", "kind"))

    def cut(self, files: DataFrame, with_data: bool = False) -> DataFrame:
        """(path, pos, start, hash, length, data, content, stable) for each chunk of each file; one row of pos null for empty ones.

        A file is read a block at a time, and again, up to ``READS`` times, if its size or
        time changed meanwhile; stable tells whether they held at last. Data are null
        unless asked for.
        """
        root, columns = self.root, ["path", "pos", "start", "hash", "length", "data", "content", "stable"]

        def once(path: str) -> tuple[list, str, bool]:
            fd = os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW)
            rows, start, whole = [], 0, hashlib.sha256()
            with os.fdopen(fd, "rb") as file:
                before = os.fstat(fd)
                for data in chunks.cut_stream(file.read):
                    whole.update(data)
                    rows.append((path, len(rows), start, hashlib.sha256(data).hexdigest(), len(data), data if with_data else None))
                    start += len(data)
                after = os.lstat(os.path.join(root, path))
            return rows, whole.hexdigest(), (before.st_size, before.st_mtime_ns, before.st_ino) == (after.st_size, after.st_mtime_ns, after.st_ino)

        def read(batches: Iterator) -> Iterator:
            import pandas as pd

            for frame in batches:
                for path in frame["path"]:
                    for _ in range(READS):
                        rows, whole, stable = once(path)
                        if stable:
                            break
                    every = [(*r, whole, stable) for r in rows] or [(path, None, None, None, None, None, whole, stable)]
                    for k in range(0, len(every), 64):
                        yield pd.DataFrame(every[k : k + 64], columns=columns).astype({"pos": "Int32", "start": "Int64", "length": "Int32"})

        return files.select("path").mapInPandas(read, "path string, pos int, start long, hash string, length int, data binary, content string, stable boolean")

    def pieces(self, wanted: DataFrame) -> DataFrame:
        """(path, hash, length, data) of parts of files, given as path, start, hash and length; data that changed meanwhile are null."""
        root = self.root

        def read(batches: Iterator) -> Iterator:
            import pandas as pd

            for frame in batches:
                for path, start, hash_, length in zip(frame["path"], frame["start"], frame["hash"], frame["length"], strict=True):
                    data = b""
                    with contextlib.suppress(OSError), os.fdopen(os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as file:
                        file.seek(start)
                        data = file.read(length)
                    ok = hashlib.sha256(data).hexdigest() == hash_
                    yield pd.DataFrame([(path, hash_, length, data if ok else None)], columns=["path", "hash", "length", "data"])

        return wanted.select("path", "start", "hash", "length").mapInPandas(read, "path string, hash string, length int, data binary")

    def put_chunks(self, new: DataFrame) -> None:
        """Insert what isn't there; data that don't have their claimed hash are an error."""
        if not new.where(F.sha2("data", 256) != F.col("hash")).isEmpty():
            raise Corrupt("a chunk doesn't have its claimed hash")
        absent = chunks.absent(new.select("hash", "length", "data"), self.chunks().select("hash"))
        self._append(stored(absent, "new-chunks").withColumn("prefix", fan_out(F.col("hash"))), "chunks", "prefix")

    def put_snapshot(self, entries: DataFrame, message: str, actor: str | None, unstable: list[str] = (), parent: str | None = None) -> str:
        """Validate and append; one that is there already, header and all, isn't stored again."""
        entries = stored(entries, "entries")
        self.validate(entries)
        n = self.snapshots().count()
        row = ("", parent, VERSION, int(time.time()), message, actor, sorted(unstable), n)
        header = self.spark.createDataFrame([row], SNAPSHOTS)
        snapshot_id = snapshot_ids(header, entries.withColumn("snapshot_id", F.lit(""))).first()["id"]
        if self.snapshots().where(F.col("snapshot_id") == snapshot_id).isEmpty():
            self._append(entries.withColumn("snapshot_id", F.lit(snapshot_id)), "entries", "snapshot_id")
            self._append(header.withColumn("snapshot_id", F.lit(snapshot_id)).coalesce(1), "snapshots")
        return snapshot_id

    def validate(self, entries: DataFrame, key: str | None = None) -> None:
        """Constraints of one manifest or, told apart by key, of several."""
        bad = diff.violations(entries, scalars.safe_path(F.col("path")), MOST_CHUNKS, MOST_FILES, key).first()
        if bad:
            raise Corrupt(f"{bad['constraint']}: {bad['path']}")

    def snap(self, message: str = "", actor: str | None = None) -> str:
        with self.lock():
            return self._snap(message, actor)

    def _snap(self, message: str, actor: str | None, event: str = "snap") -> str:
        """Scan, cut, drop what is tombstoned, store, append, move HEAD. A blank actor is none."""
        actor = actor.strip() or None if actor else None
        tombs = self.tombstones().select("path", "content")
        files = self.live().where("kind = 'file'").join(tombs.select("path"), "path", "left_anti")
        before = stored(files, "scan")
        cut = stored(self.cut(before).drop("data").join(tombs.select("content"), "content", "left_anti"), "cut")
        # hashes first; only data that aren't there are read again and travel
        data = stored(self.pieces(chunks.absent(cut.where("pos IS NOT NULL"), self.chunks().select("hash"))), "pieces")
        torn = stored(data.where("data IS NULL").select("path").distinct(), "torn")
        if not torn.isEmpty():  # these changed between the two looks: what one look sees counts
            again = stored(self.cut(torn, with_data=True).join(tombs.select("content"), "content", "left_anti"), "cut-again")
            self.put_chunks(again.where("pos IS NOT NULL"))
            again = again.drop("data").withColumn("stable", F.lit(False))
            cut = stored(cut.join(torn, "path", "left_anti").unionByName(again), "cut")
        self.put_chunks(data.where("data IS NOT NULL"))
        lists = cut.groupBy("path", "content").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "hash")))), lambda x: x["hash"]).alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.bool_and("stable").alias("stable"))
        rows = stored(before.drop("content").join(lists, "path"), "rows")
        moved = ~F.col("stable") | (F.col("bytes") != F.col("size"))
        unstable = [r["path"] for r in rows.where(moved).select("path").collect()]  # a list in the snapshot's header
        entries = ordering.numbered(rows, F.split("path", "/"), name="pos").select("pos", "path", scalars.mode_bits(F.col("mode")).alias("mode"), F.col("bytes").alias("size"), "mtime_secs", "mtime_nanos", "content", "chunks")
        snapshot_id = self.put_snapshot(entries, message, actor, unstable, self.head())
        self.set_head(snapshot_id)
        self.record(event, f"{snapshot_id[:12]} {message}")
        return snapshot_id

    def chain(self) -> DataFrame:
        head = self.head()
        snaps = self.snapshots()
        if head is None:
            return snaps.select("snapshot_id", F.lit(0).cast("long").alias("depth")).limit(0)
        found = history.chain(snaps, head)
        if not history.missing_parents(snaps, found).isEmpty():
            raise MissingObject("an ancestor of HEAD is missing")
        return found

    def log(self, n: int = 20) -> DataFrame:
        """The newest snapshots, with how many files each has."""
        listed = stored(history.log(history.listing(self.snapshots(), self.chain()), n), "log")  # n rows
        files = self.entries().join(listed.select("snapshot_id"), "snapshot_id", "left_semi").groupBy("snapshot_id").agg(F.count("*").alias("files"))
        return listed.join(files, "snapshot_id", "left").fillna(0, ["files"]).orderBy(*history.newest_first())

    def object(self, hash_: str) -> bytes:
        """The data of one chunk, checked."""
        try:
            data = chunks.point_read(self.chunks().where(F.col("prefix") == hash_[:2].lower()), hash_)
        except ValueError as e:
            raise Corrupt(str(e)) from e
        if data is None:
            raise MissingObject(hash_)
        return data

    def show(self, reference: str = "head") -> DataFrame:
        snapshot_id = self.resolve(reference)
        if self.snapshots().where(F.col("snapshot_id") == snapshot_id).isEmpty():
            raise MissingObject(snapshot_id)
        return self.entries(snapshot_id).orderBy("pos")

    def diff(self, old: str, new: str = "head") -> DataFrame:
        return diff.diff(self.entries(self.resolve(new)), self.entries(self.resolve(old)))

    def status(self, reference: str = "head", full: bool = False) -> DataFrame:
        """Drift of the worktree. Only files whose stamps differ are read, unless full."""
        manifest = self.entries(self.resolve(reference)) if self.head() or reference not in ("head", "HEAD") else self.entries().limit(0)
        live = self.live().where("kind = 'file'").drop("content")
        stamps = manifest.select("path", *diff.STAMP)
        unread = live.join(stamps, ["path", *diff.STAMP], "left_semi") if not full else live.limit(0)
        read = self.hashed(live.join(unread.select("path"), "path", "left_anti").join(manifest.select("path"), "path", "left_semi"))
        new = live.join(manifest.select("path"), "path", "left_anti").withColumn("content", F.lit(None).cast("string"))
        known = unread.join(manifest.select("path", "content"), "path")
        return diff.drift(stored(read.unionByName(new).unionByName(known), "live"), manifest, full=full)

    # --- revert ---

    def revert(self, reference: str, keep_extra: bool = False, force: bool = False) -> DataFrame:
        with self.lock():
            snapshot_id = self.resolve(reference)
            report = self._apply(self.show(snapshot_id), keep_extra, force)
            self.set_head(snapshot_id)
            self.record("revert", snapshot_id[:12])
            return report

    def _apply(self, manifest: DataFrame, keep_extra: bool, force: bool) -> DataFrame:
        """Gate, refuse what is purged, then write, remove and prune."""
        if not force and self.status(full=True).agg(diff.is_dirty(F.lit(None))).first()[0]:
            raise Dirty("the worktree has changes that no snapshot has")
        manifest = stored(manifest.drop("snapshot_id"), "manifest")
        self.validate(manifest)
        refused = purge.first_refused(manifest.select("path", "content", "pos"), self.tombstones()).first()
        if refused["n"]:
            raise Purged(refused["path"])
        live = stored(self.hashed(self.live(ignore=False)), "live")
        writes = stored(diff.write_set(manifest, live), "writes")
        gone = stored(diff.extras(live, manifest, keep_extra), "extras")
        self._write(writes)
        bits = scalars.MODE_BITS
        self._each(manifest.select("path", "mode"), lambda path, mode: os.chmod(path, bits & mode))
        self._each(gone.where("action = 'removed'").select("path"), os.unlink)
        if not keep_extra:
            self._prune(diff.empty_directories(live, manifest))
        return writes.select("path", F.lit("restored").alias("action")).unionByName(gone)

    def _each(self, rows: DataFrame, act: Callable, missing_ok: bool = False) -> None:
        """act(full path, *other columns) for each row, on the executors."""
        root, ok = self.root, FileNotFoundError if missing_ok else ()

        def run(batches: Iterator) -> Iterator:
            for frame in batches:
                for path, *rest in frame.itertuples(index=False):
                    with contextlib.suppress(ok):
                        act(os.path.join(root, path), *rest)
                yield frame.iloc[:, :1]

        rows.mapInPandas(run, "path string").count()

    def _prune(self, directories: DataFrame) -> None:
        """Remove directories that are empty, the deepest first: a job for each depth."""

        def remove(path: str) -> None:
            with contextlib.suppress(OSError):
                os.rmdir(path)

        found = stored(directories, "directories")
        for depth in sorted((r[0] for r in found.select("depth").distinct().collect()), reverse=True):
            self._each(found.where(F.col("depth") == depth).select(F.col("dir").alias("path")), remove)

    def _write(self, writes: DataFrame) -> None:
        """Put files in place by rename, each checked against its content hash; links on the way are refused."""
        root = self.root
        pieces = writes.select("path", "content", F.posexplode_outer("chunks").alias("pos", "hash"))
        data = self.chunks().select("hash", "data").join(pieces.select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
        rows = pieces.join(data, "hash", "left")

        def place(group):
            path, content = group["path"].iloc[0], group["content"].iloc[0]
            group = group.sort_values("pos")
            at = root
            for part in path.split("/")[:-1]:
                at = os.path.join(at, part)
                if os.path.islink(at) or os.path.exists(at) and not os.path.isdir(at):
                    raise Corrupt(f"{at} is in the way")
                os.makedirs(at, exist_ok=True)
            data = b"".join(d for d in group["data"] if d is not None)
            if hashlib.sha256(data).hexdigest() != content:
                raise Corrupt(f"{path}: its chunks don't give its content")
            tmp = os.path.join(at, f".{secrets.token_hex(8)}.tmp")
            with open(tmp, "xb") as file:
                file.write(data)
                file.flush()
                os.fsync(file.fileno())
            os.replace(tmp, os.path.join(root, path))
            return group.iloc[:1][["path"]]

        rows.groupBy("path").applyInPandas(place, "path string").count()

    def revert_actor(self, name: str) -> DataFrame:
        """Undo one actor's changes and keep everyone else's; a new snapshot without actor records it."""
        with self.lock():
            chain = stored(self.chain(), "chain")
            last = chain.agg(F.max("depth")).first()[0]
            seqs = chain.select("snapshot_id", (F.lit(last) - F.col("depth")).alias("seq")).join(self.snapshots().select("snapshot_id", "actor"), "snapshot_id")
            entries = stored(self.entries().join(seqs, "snapshot_id"), "history")
            facts = entries.select("seq", "path", "content", "actor")
            if undo.touched(facts, seqs, name).isEmpty():
                raise undo.NoChanges(f"no changes by {name}")
            wanted = undo.manifest(facts, seqs, name, F.lit(last))
            versions = entries.groupBy("path", "content").agg(F.max_by(F.struct("mode", "size", "mtime_secs", "mtime_nanos", "chunks"), "seq").alias("e"))
            manifest = wanted.join(versions, ["path", "content"]).select(F.lit(0).cast("long").alias("pos"), "path", "e.mode", "e.size", "e.mtime_secs", "e.mtime_nanos", "content", "e.chunks")
            gone = stored(undo.removed(facts, seqs, name, F.lit(last)).select("path"), "undone")
            manifest = ordering.numbered(manifest.drop("pos"), F.split("path", "/"), name="pos").select(manifest.columns)
            report = self._apply(manifest, keep_extra=True, force=False)
            self._each(gone, os.unlink, missing_ok=True)
            self._snap(f"undo {name}", None, "revert-actor")
            return report

    def guard(self, command: list[str], revert: str = "never", full: bool = False) -> GuardReport:
        """Snapshot, run a command in the worktree, report what it changed, and restore the snapshot as asked (never, on-fail, always)."""
        if not command:
            raise WarehouseError("guard needs a command")
        with self.lock():
            before = self.head()
            snapshot_id = self._snap(f"guard: {' '.join(command)}", None, "guard-snap")
            try:
                code = subprocess.run(command, cwd=self.root, check=False).returncode
            except OSError:
                atomic_write(self._at("HEAD"), before or "")
                raise
            changes = [(r["path"], r["status"]) for r in self.status(full=full).orderBy("path").collect()]
            report = GuardReport(snapshot_id, code if code >= 0 else None, -code if code < 0 else None, changes, False)
            if revert == "always" or revert == "on-fail" and report.process_exit_code():
                self._apply(self.show(snapshot_id), keep_extra=False, force=True)
                report.reverted = True
            self.record("guard", f"{' '.join(command)} -> {report.process_exit_code()}")
            return report

    # --- verification, erasure, replication ---

    def verify(self, objects: bool = False) -> dict:
        log = self.audit()
        rows = chains.checked(log).select("line_no", "raw", "seq", "ok").orderBy("line_no")
        first = rows.where("seq IS NULL OR NOT coalesce(ok, false)").first()
        if first is not None and first["seq"] is None:
            raise Corrupt(f"audit line {first['line_no'] + 1}")
        out = {"entries": log.count(), "valid": first is None, "first_bad": None if first is None else first["seq"]}
        if objects:
            out |= chunks.object_counts(self.chunks(), F.col("data")).first().asDict()
        return out

    def purge(self, path: str, key: tuple[bytes, str]) -> dict:
        """Sweep chunks that only this path uses, tombstone it, remove it from the worktree; a signed certificate."""
        with self.lock():
            target = os.path.join(self.root, path)
            used = stored(self.entries().select("snapshot_id", "path", "content", F.explode_outer("chunks").alias("hash")), "uses")
            times = self.snapshots().select("snapshot_id", "timestamp_secs", "n")
            newest = used.where(F.col("path") == path).join(times, "snapshot_id").agg(F.max_by("content", F.struct("timestamp_secs", "n"))).first()[0]
            content = hash_file(target) or newest
            if content is None:
                raise WarehouseError(f"nothing to purge: {path}")
            tombs = self.tombstones()
            if not tombs.where((F.col("path") == path) | (F.col("content") == content)).isEmpty():
                raise Purged(f"{path} is already purged")
            counts = purge.purge_counts(used.where(F.col("hash").isNotNull()), self.chunks(), path).first().asDict()
            doomed = stored(purge.sweep(used.where(F.col("hash").isNotNull()), path).where("action = 'delete'").select("hash"), "doomed")
            self._sweep(doomed)
            ts = int(time.time())
            tomb = {"path": path, "content": content, "purge_id": hashlib.sha256(f"{path}:{content}".encode()).hexdigest()[:16], "ts": ts}
            with open(self._at("tombstones.jsonl"), "a", encoding="utf-8") as file:
                file.write(json.dumps(tomb, ensure_ascii=False) + "\n")
            live_removed = os.path.exists(target)
            if live_removed:
                os.unlink(target)
            payload = {"type": "tidemark-purge", "version": 1, "warehouse_id": self.warehouse_id(), **tomb, **counts, "live_removed": live_removed}
            self.record("purge", path)
            return payload | {"certificate": signing.signed_document(self.spark, CERTIFICATE, payload, key)}

    def _sweep(self, doomed: DataFrame) -> None:
        """Delete chunks: the folders they lie in are written anew beside the table and then swapped, under a journal."""
        prefixes = sorted(r[0] for r in doomed.select(fan_out(F.col("hash"))).distinct().collect())  # 256 at most
        if not prefixes:
            return
        staging = f"sweep-{secrets.token_hex(8)}"
        kept = stored(self.chunks().where(F.col("prefix").isin(prefixes)).join(doomed, "hash", "left_anti"), "kept-chunks")
        full = sorted(r[0] for r in kept.select("prefix").distinct().collect())
        kept.write.option("compression", "zstd").partitionBy("prefix").parquet(self._uri(staging))
        atomic_write(self._at("sweep"), json.dumps({"staging": staging, "full": full, "empty": [p for p in prefixes if p not in full]}))
        self._end_sweep()

    def _end_sweep(self) -> None:
        """Carry out the journal, if there is one: each folder that waits takes its place, others go. A part that is done isn't found again."""
        try:
            with open(self._at("sweep")) as file:
                journal = json.load(file)
        except FileNotFoundError:
            return
        fs, staging = self._fs(self._uri(journal["staging"]))
        place = lambda base, prefix: self._fs(self._uri(base, f"prefix={prefix}"))[1]
        for prefix in journal["full"]:
            new, old = place(journal["staging"], prefix), place("chunks", prefix)
            if fs.exists(new):
                fs.delete(old, True)
                if not fs.rename(new, old):
                    raise OSError(f"could not replace {old.toString()}")
        for prefix in journal["empty"]:
            fs.delete(place("chunks", prefix), True)
        os.unlink(self._at("sweep"))
        fs.delete(staging, True)

    def verify_certificate(self, certificate: str, pubkey: str | None = None, objects: bool = False) -> dict:
        """The payload of a certificate whose tombstone is here; with objects, also that no chunk of the content is left."""
        payload = signing.opened(self.spark, certificate, CERTIFICATE, pubkey)
        if payload.get("warehouse_id") != self.warehouse_id():
            raise Corrupt("a certificate of another warehouse")
        row = self.spark.createDataFrame([(payload["path"], payload["content"])], "path string, content string")
        if purge.certified(row, self.tombstones()).isEmpty():
            raise Corrupt("no tombstone for this certificate")
        if objects:
            uses = self.entries().where(F.col("content") == payload["content"]).select(F.explode("chunks").alias("hash"))
            others = self.entries().where(F.col("content") != payload["content"]).select(F.explode("chunks").alias("hash"))
            if not self.chunks().join(uses.join(others, "hash", "left_anti"), "hash", "left_semi").isEmpty():
                raise Corrupt("chunks of the content are left")
        return payload

    def pull(self, peer: Warehouse, name: str | None = None) -> dict:
        """Fetch what HEAD of another warehouse reaches and this one lacks: manifests are verified first, then chunks, then manifests are stored.

        A warehouse without snapshots becomes a copy of the other one and takes its id, so
        that orders and certificates of the one hold for the other.
        """
        with self.lock():
            return self._pull(peer, name)

    def _pull(self, peer: Warehouse, name: str | None = None) -> dict:
        remote_head = peer.head()
        if remote_head is None:
            return {"remote_head": None, "manifests_fetched": 0, "fetched": 0, "skipped": 0, "remote_missing": 0}
        first = self.snapshots().isEmpty()
        reached = stored(peer.chain().select("snapshot_id"), "reached")
        theirs = peer.snapshots().join(reached, "snapshot_id", "left_semi")
        new = stored(theirs.join(self.snapshots(), "snapshot_id", "left_anti"), "new-snapshots")
        entries = stored(peer.entries().join(new, "snapshot_id", "left_semi").select(self.entries().columns), "new-entries")
        other = new.where(~F.col("version").isin(*VERSIONS)).first()
        if other:
            raise Corrupt(f"version {other['version']} of {other['snapshot_id'][:12]}")
        self.validate(entries, "snapshot_id")
        forged = snapshot_ids(new, entries).where("id != snapshot_id").first()
        if forged:
            raise Corrupt(f"a manifest doesn't have its id {forged['snapshot_id'][:12]}")
        needed = peer.entries().join(reached, "snapshot_id", "left_semi").select(F.explode("chunks").alias("hash"))
        counts = replication.pull_counts(needed, peer.chunks(), self.chunks()).first().asDict()
        self.put_chunks(peer.chunks().join(replication.fetch_set(needed, peer.chunks(), self.chunks()), "hash", "left_semi"))
        n = new.count()
        if n:
            self._append(entries, "entries", "snapshot_id")
            self._append(new.select(self.snapshots().columns), "snapshots")
        if first:
            atomic_write(self._at("warehouse_id"), peer.warehouse_id())
        ref = self.spark.range(1).select(scalars.ref_name(F.lit(name or peer.root))).first()[0]
        atomic_write(self._at("remotes", ref), remote_head)
        self.record("pull", f"{ref} {remote_head[:12]}")
        return {"remote_head": remote_head, "manifests_fetched": n, **counts}

    # --- checkpoints and orders ---

    def warehouse_id(self) -> str:
        with open(self._at("warehouse_id")) as file:
            return file.read().strip()

    def _tip(self) -> tuple[int, str]:
        row = chains.tips(self.audit().where("seq IS NOT NULL")).first() if os.path.exists(self._at("audit.jsonl")) else None
        return (row["entries"], row["tip"]) if row and row["tip"] else (0, "")

    def anchor(self, folder: str, key: tuple[bytes, str]) -> str:
        """Sign length and tip of the audit log into a new file outside the store; its path."""
        folder = os.path.realpath(folder)
        if os.path.commonpath([folder, os.path.realpath(self.path)]) == os.path.realpath(self.path):
            raise WarehouseError("an anchor inside the store anchors nothing")
        os.makedirs(folder, exist_ok=True)
        length, tip = self._tip()
        prev = None
        with contextlib.suppress(FileNotFoundError), open(self._at("last_anchor")) as file:
            prev = file.read().strip() or None
        payload = {"type": "tidemark-anchor", "version": 1, "warehouse_id": self.warehouse_id(), "audit_len": length, "audit_tip": tip, "head": self.head(), "prev_anchor": prev, "ts": int(time.time())}
        text, millis, n = signing.signed_document(self.spark, ANCHOR, payload, key), time.time_ns() // 1_000_000, 0
        while True:
            path = os.path.join(folder, f"anchor-{millis}{f'-{n}' if n else ''}.json")
            try:
                fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o644)
                break
            except FileExistsError:
                n += 1
        with os.fdopen(fd, "w") as file:
            file.write(text)
        atomic_write(self._at("last_anchor"), hashlib.sha256(text.encode()).hexdigest())
        self.record("anchor", os.path.basename(path))
        return path

    def verify_anchor(self, path: str, pubkey: str | None = None, prev: str | None = None) -> dict:
        """Signature, warehouse, and that the log still begins with what was anchored; with prev, that this anchor follows that file."""
        with open(path) as file:
            payload = signing.opened(self.spark, file.read(signing.LONGEST_DOCUMENT + 1), ANCHOR, pubkey.lower() if pubkey else None)
        if payload["warehouse_id"] != self.warehouse_id():
            raise Corrupt("an anchor of another warehouse")
        log = self.audit().where("seq IS NOT NULL").withColumn("one", F.lit(1))
        wanted = self.spark.createDataFrame([(1, payload["audit_len"], payload["audit_tip"])], "one int, audit_len long, audit_tip string")
        if not chains.anchored(log, wanted, "one").first()["ok"]:
            raise Corrupt("the audit log doesn't begin as it was anchored")
        if prev is not None:
            with open(prev) as file:
                text = file.read()
            signing.opened(self.spark, text, ANCHOR, payload["pubkey"])
            if payload.get("prev_anchor") != hashlib.sha256(text.encode()).hexdigest():
                raise Corrupt("the anchor doesn't follow the one before")
        return payload

    def trust(self, pubkey: str) -> None:
        """Pin the key that signs orders; the first pin stays."""
        try:
            with open(self._at("fleet.pub"), "x") as file:
                file.write(pubkey)
        except FileExistsError:
            with open(self._at("fleet.pub")) as file:
                if file.read().strip() != pubkey:
                    raise WarehouseError("another key is pinned") from None
        self.record("fleet-trust", pubkey)

    def order(self, target: str, key: tuple[bytes, str]) -> str:
        """A signed order to land on a snapshot of this warehouse."""
        payload = {"kind": "tidemark-order", "warehouse_id": self.warehouse_id(), "target": self.resolve(target), "ts": int(time.time()), "nonce": secrets.token_hex(16)}
        self.record("fleet-order", payload["target"][:12])
        return signing.signed_document(self.spark, ORDER, payload, key)

    def apply_order(self, order: str, source: Warehouse | None = None, force: bool = False) -> DataFrame:
        """Verify against the pinned key, refuse orders of other warehouses and orders older than the last, pull what is missing if a source is given, revert."""
        try:
            with open(self._at("fleet.pub")) as file:
                pinned = file.read().strip()
        except FileNotFoundError:
            raise WarehouseError("no fleet key is pinned") from None
        payload = signing.opened(self.spark, order, ORDER, pinned)
        with self.lock():
            last = 0
            with contextlib.suppress(FileNotFoundError), open(self._at("last_order")) as file:
                last = int(file.read())
            if payload["ts"] < last:
                raise WarehouseError("an order older than the last one")
            absent = self.snapshots().where(F.col("snapshot_id") == payload["target"]).isEmpty()
            if source is not None and absent and self.snapshots().isEmpty() and source.warehouse_id() == payload["warehouse_id"]:
                self._pull(source)  # an empty warehouse takes the other's id
            if payload.get("warehouse_id") != self.warehouse_id():
                raise Corrupt("an order for another warehouse")
            if source is not None and absent:
                self._pull(source)
            report = self._apply(self.show(payload["target"]), keep_extra=False, force=force)
            self.set_head(payload["target"])
            atomic_write(self._at("last_order"), str(max(last, payload["ts"])))
            self.record("fleet-revert", payload["target"][:12])
            return report


__all__ = ["Corrupt", "Dirty", "GuardReport", "Locked", "MissingObject", "Purged", "Warehouse", "WarehouseError", "find_root"]

"""A store: Parquet files, listed by versions of a manifest.

A commit writes its files first and then one manifest file under a name that must
not exist; readers see what a manifest lists and nothing else, so a job that dies
half way leaves only files to vacuum.  All paths go through Hadoop's file systems.
Manifest rows are one for each commit's folder and column family, not for each row
of data; they hold key ranges and counts, so reads and rewrites with bounds leave
out folders, and tables of files need no data.

Of two writers one wins where a name is taken at once: in HDFS, whose rename does
not overwrite, and on a local disk, by a hard link.  Object stores whose rename
overwrites need a single writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.functions.codecs import pack_columns, unpack_columns
from versionlog.model import DEFAULT_CF, DELETE, FILES, MERGE, OPLOG, RANGE_DELETE, SINGLE_DELETE, Conflict, InvalidInput, NotFound, ReadOnly, empty_log
from versionlog.operators import compact as rewriting
from versionlog.operators import ingest as loading
from versionlog.operators.batch import WriteBatch
from versionlog.operators.inspect import int_property, properties
from versionlog.operators.merge import MergeOperator
from versionlog.operators.resolve import resolve
from versionlog.operators.scan import bounded, get
from versionlog.operators.txn import conflicts


class _Files:
    """A few file operations over Hadoop."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> None:
        """Write under a temporary name, then take the final one, which fails if it is taken."""
        aside, final = self.path(f"{p}.{uuid.uuid4().hex}"), self.path(p)
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            taken = self.exists(p) or not self._take(aside, final)
        finally:
            self.fs.delete(aside, False)
        if taken:
            raise Conflict(f"{p} was committed by another writer")

    def _take(self, aside, final) -> bool:
        if self.fs.getUri().getScheme() != "file":
            return self.fs.rename(aside, final)
        local = [self.jvm.java.nio.file.Paths.get(self.fs.makeQualified(x).toUri()) for x in (final, aside)]
        try:
            self.jvm.java.nio.file.Files.createLink(*local)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def copy(self, a: str, b: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(a), self.path(b).getFileSystem(self.conf), self.path(b), False, self.conf)


@dataclass
class Version:
    """What a manifest says."""

    number: int
    last_seq: int
    folders: list[dict]  # path, level, first_seq, last_seq, created_at, stats (a dict for each column family)
    cfs: dict[str, int]
    next_cf: int
    snapshots: dict[str, list[int]]  # seq -> created_at of each
    options: dict[str, str]

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


#: Options that may be set on an open store; others are ignored.
DYNAMIC_OPTIONS = ("disable_auto_compactions", "level0_file_num_compaction_trigger", "max_background_jobs")


class Store:
    def __init__(self, spark: SparkSession, root: str, merge: str | MergeOperator | None = None, read_only: bool = False, create: bool = True) -> None:
        self.spark, self.root, self.merge, self.read_only = spark, root.rstrip("/"), merge, read_only
        self.files = _Files(spark, root)
        if not self.versions():
            if read_only or not create:
                raise NotFound(root)
            self._commit(Version(0, 0, [], {"default": DEFAULT_CF}, 1, {}, {}))
        self.version = self.load()

    # --- versions

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifest/{number:020d}.json"

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/manifest") if n.endswith(".json") and n[:-5].isdigit()]

    def load(self, number: int | None = None) -> Version:
        known = self.versions()
        number = known[-1] if number is None and known else number
        if number not in known:
            raise NotFound(f"version {number}")
        return Version(**json.loads(self.files.read(self._manifest(number))))

    def refresh(self) -> Version:
        """Catch up with what other writers have committed."""
        self.version = self.load()
        return self.version

    def _commit(self, version: Version) -> Version:
        if self.read_only:
            raise ReadOnly(self.root)
        self.files.create(self._manifest(version.number), version.to_json())
        self.version = version
        return version

    def _next(self, **changes) -> Version:
        v = self.version
        return Version(**{**json.loads(v.to_json()), "number": v.number + 1, **changes})

    # --- data

    def _append(self, rows: DataFrame, first_seq: int, last_seq: int) -> Version:
        if self.read_only:
            raise ReadOnly(self.root)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        # clustered by column family and key, so that bounds on keys skip row groups
        rows.sortWithinPartitions("cf_id", "key", F.desc("seq")).write.parquet(path)
        folder = self._folder(path, 0, first_seq, last_seq)
        return self._commit(self._next(last_seq=max(last_seq, self.version.last_seq), folders=[*self.version.folders, folder]))

    def _folder(self, path: str, level: int, first_seq: int, last_seq: int) -> dict:
        """A manifest's entry of a folder that was written, with its counts."""
        is_range = F.col("op") == RANGE_DELETE
        size = F.sum((F.length("key") + F.coalesce(F.length("value"), F.lit(0))).cast("long"))
        counted = self.spark.read.schema(OPLOG).parquet(path).groupBy("cf_id").agg(
            size.alias("size"), F.hex(F.min("key")).alias("smallest"), F.hex(F.max("key")).alias("largest"), F.hex(F.max(F.when(is_range, F.col("end_key")))).alias("reach"),
            F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.count("*").alias("num_entries"), F.count_if(F.col("op").isin(DELETE, SINGLE_DELETE)).alias("num_deletes"),
            F.count_if(F.col("op") == MERGE).alias("num_merges"), F.count_if(is_range).alias("num_range_dels"),
        )
        stats = sorted((r.asDict() for r in counted.collect()), key=lambda r: r["cf_id"])
        return {"path": path, "level": level, "first_seq": first_seq, "last_seq": last_seq, "created_at": int(time.time()), "stats": stats}

    @staticmethod
    def _meets(folder: dict, lower: bytes | None, upper: bytes | None, cfs: Sequence[int] | None = None) -> bool:
        """May the folder hold anything of the keys in [lower, upper)?  Hexadecimal digits sort as their bytes do."""
        low, high = (None if x is None else x.hex().upper() for x in (lower, upper))
        for s in folder["stats"]:
            last = max(s["largest"], s["reach"] or "")
            if (cfs is None or s["cf_id"] in cfs) and (high is None or s["smallest"] < high) and (low is None or last >= low):
                return True
        return False

    def _overlap(self, one: dict, other: dict) -> bool:
        for s in one["stats"]:
            for t in other["stats"]:
                if s["cf_id"] == t["cf_id"] and s["smallest"] <= max(t["largest"], t["reach"] or "") and t["smallest"] <= max(s["largest"], s["reach"] or ""):
                    return True
        return False

    def log(self, version: Version | None = None, lower: bytes | None = None, upper: bytes | None = None, cfs: Sequence[int] | None = None) -> DataFrame:
        """Rows of the column families that exist.  With bounds, of the folders that may hold such keys."""
        version = version or self.version
        paths = [f["path"] for f in version.folders if self._meets(f, lower, upper, cfs)]
        if not paths:
            return empty_log(self.spark)
        return self.spark.read.schema(OPLOG).parquet(*paths).where(F.col("cf_id").isin(*version.cfs.values()))

    def write(self, batch: WriteBatch) -> int:
        """Commit a batch; returns the seq of its first operation."""
        if not len(batch):
            return self.version.last_seq
        known = set(self.version.cfs.values())
        if any(o[0] not in known for o in batch.operations):
            raise NotFound("column family")
        first = self.version.last_seq + 1
        self._append(batch.to_log(self.spark, first).coalesce(1), first, first + len(batch) - 1)
        return first

    def put_entity(self, key: bytes, columns: dict[bytes, bytes], cf: int = DEFAULT_CF) -> int:
        return self.write(WriteBatch().put_entity(key, pack_columns(columns), cf))

    def delete_entity(self, key: bytes, cf: int = DEFAULT_CF) -> int:
        return self.write(WriteBatch().delete(key, cf))

    def merge_entity(self, key: bytes, columns: dict[bytes, bytes], cf: int = DEFAULT_CF) -> int:
        """The columns that are there, and these over them.  A writer in between makes the commit fail."""
        there = get(self.log(cfs=[cf], lower=key), key, cf, merge=self.merge).select("value").take(1)
        old = unpack_columns(bytes(there[0][0])) if there and there[0][0] is not None else {}
        return self.put_entity(key, {**old, **columns}, cf)

    def append_log(self, rows: DataFrame) -> None:
        """Commit rows that have their seqs already."""
        low, high = rows.agg(F.min("seq"), F.max("seq")).first()
        if low is not None:
            self._append(rows, low, high)

    def state(self, snapshot: int | None = None, lower: bytes | None = None, upper: bytes | None = None, cfs: Sequence[int] | None = None, **how) -> DataFrame:
        return resolve(bounded(self.log(lower=lower, upper=upper, cfs=cfs), lower, upper, cfs), snapshot, merge=self.merge, **how)

    def ingest(self, files: list[DataFrame], options: loading.IngestOptions | None = None, cf: str = "default") -> None:
        """One commit for all files; seqs by order of the arguments."""
        options = options or loading.IngestOptions()
        first = self.version.last_seq + 1
        rows = loading.ingest(empty_log(self.spark), files, first, options, self.cf(cf))
        if options.fail_if_not_bottommost:
            loading.ingest(self.log(), files, first, options, self.cf(cf))
        self._append(rows, 0 if options.behind else first, 0 if options.behind else first + len(files) - 1)

    def compact(self, filter_=None, lower: bytes | None = None, upper: bytes | None = None) -> list[str]:
        """Rewrite what the live snapshots need of keys in [lower, upper), or of all; returns the folders that went.

        Only folders that may hold such keys are read.  One alone that is not on the last level, overlaps no other and
        has neither deletions nor operands is moved there instead.  Old folders stay until vacuumed.
        """
        chosen = [f for f in self.version.folders if self._meets(f, lower, upper)]
        if not chosen:
            return []
        alone = filter_ is None and len(chosen) == 1 and chosen[0]["level"] < rewriting.LEVELS - 1
        if alone and self._plain(chosen[0]) and not any(self._overlap(chosen[0], f) for f in self.version.folders if f is not chosen[0]):
            self.move(chosen[0]["path"])
            return []
        return self._rewrite(chosen, True, filter_, lower, upper)

    def compact_files(self, paths: Sequence[str], filter_=None) -> list[str]:
        """Rewrite these folders into one.  Deletions stay where another folder may hold older rows.

        Folders that overlap in keys and lie between them by seqs are taken along: operands must not fold past their rows.
        """
        chosen = [f for f in self.version.folders if f["path"] in paths]
        if len(chosen) != len(set(paths)) or not chosen:
            raise NotFound("a folder that is not live")
        rest = [f for f in self.version.folders if f["path"] not in paths]
        while True:
            low, high = min(f["first_seq"] for f in chosen), max(f["last_seq"] for f in chosen)
            between = [f for f in rest if f["first_seq"] <= high and f["last_seq"] >= low and any(self._overlap(f, g) for g in chosen)]
            if not between:
                break
            chosen, rest = chosen + between, [f for f in rest if f not in between]
        return self._rewrite(chosen, not any(self._overlap(f, g) for f in chosen for g in rest), filter_, None, None)

    @staticmethod
    def _plain(folder: dict) -> bool:
        return all(s["num_deletes"] == s["num_merges"] == s["num_range_dels"] == 0 for s in folder["stats"])

    def move(self, path: str, level: int = rewriting.LEVELS - 1) -> None:
        """Put a folder on a deeper level without reading it; none on the way may overlap it."""
        (folder,) = [f for f in self.version.folders if f["path"] == path] or [None]
        if folder is None:
            raise NotFound(path)
        if any(self._overlap(folder, f) for f in self.version.folders if f is not folder and folder["level"] < f["level"] <= level):
            raise InvalidInput("a folder of a deeper level overlaps")
        self._commit(self._next(folders=[{**f, "level": level} if f["path"] == path else f for f in self.version.folders]))

    def _rewrite(self, chosen: list[dict], full: bool, filter_, lower: bytes | None, upper: bytes | None) -> list[str]:
        snapshots = [int(s) for s in self.version.snapshots]
        paths = [f["path"] for f in chosen]
        log = self.spark.read.schema(OPLOG).parquet(*paths).where(F.col("cf_id").isin(*self.version.cfs.values()))
        whole = len(chosen) == len(self.version.folders)
        rows = rewriting.compact(log, snapshots, self.merge, filter_, lower, upper, full=full, ranges_too=full and whole)
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.repartitionByRange("cf_id", "key").sortWithinPartitions("cf_id", "key", F.desc("seq")).write.parquet(path)
        made = self._folder(path, rewriting.LEVELS - 1 if full else max(f["level"] for f in chosen), min(f["first_seq"] for f in chosen), max(f["last_seq"] for f in chosen))
        self._commit(self._next(folders=[*[f for f in self.version.folders if f["path"] not in paths], made]))
        return paths

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete folders that none of the last versions lists; returns them."""
        keep = {f["path"].rsplit("/", 1)[1] for n in self.versions()[-keep_versions:] for f in self.load(n).folders}
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in keep]
        for n in gone:
            self.files.delete(f"{self.root}/data/{n}")
        return gone

    # --- snapshots, column families, options

    def snapshot(self) -> int:
        live = {k: list(v) for k, v in self.version.snapshots.items()}
        live.setdefault(str(self.version.last_seq), []).append(int(time.time()))
        self._commit(self._next(snapshots=live))
        return self.version.last_seq

    def release(self, snapshot: int) -> None:
        live = {k: list(v) for k, v in self.version.snapshots.items()}
        if str(snapshot) not in live:
            raise NotFound(f"snapshot {snapshot}")
        live[str(snapshot)].pop()
        self._commit(self._next(snapshots={k: v for k, v in live.items() if v}))

    def create_cf(self, name: str) -> int:
        if name in self.version.cfs:
            raise InvalidInput(f"column family {name} exists")
        number = self.version.next_cf
        self._commit(self._next(cfs={**self.version.cfs, name: number}, next_cf=number + 1))
        return number

    def drop_cf(self, name: str) -> None:
        if name == "default":
            raise InvalidInput("the default column family stays")
        self.cf(name)
        self._commit(self._next(cfs={k: v for k, v in self.version.cfs.items() if k != name}))

    def cf(self, name: str) -> int:
        if name not in self.version.cfs:
            raise NotFound(f"column family {name}")
        return self.version.cfs[name]

    def set_options(self, options: dict[str, str]) -> dict[str, str]:
        """Known options are set, unknown ones ignored; a value that is no number is an error."""
        taken = {}
        for k, v in options.items():
            if k in DYNAMIC_OPTIONS:
                try:
                    taken[k] = str({"true": 1, "false": 0}.get(str(v).lower(), v) if k.startswith("disable") else int(v))
                except ValueError:
                    raise InvalidInput(f"{k} is not a number") from None
        self._commit(self._next(options={**self.version.options, **taken}))
        return self.version.options

    # --- transactions

    def commit_transaction(self, batch: WriteBatch, tracked: DataFrame) -> int:
        """Optimistic: ``tracked`` (txn_id, cf_id, key, seq) must have no newer write."""
        self.refresh()
        if not conflicts(tracked, self.log()).isEmpty():
            raise Conflict("a tracked key was written since")
        return self.write(batch)

    # --- copies

    def live_files(self) -> list[str]:
        return [f["path"] for f in self.version.folders]

    def properties(self) -> DataFrame:
        """Named integers of this version: name, value."""
        live = [(int(s), t) for s, times in self.version.snapshots.items() for t in times]
        snapshots = self.spark.createDataFrame(live, "seq long, created_at long")
        return properties(self.log(), self.files_table(), snapshots)

    def property(self, name: str) -> int | None:
        """One of them; None if there is none of that name."""
        return int_property(self.properties(), name)

    def sorted_logs(self) -> DataFrame:
        """Folders in order of their seqs."""
        rows = [(k, f["path"], f["first_seq"], f["last_seq"]) for k, f in enumerate(sorted(self.version.folders, key=lambda f: f["first_seq"]))]
        return self.spark.createDataFrame(rows, "number int, path string, first_seq long, last_seq long")

    def checkpoint(self, target: str) -> Store:
        """A store of its own with this version's data; the target must not exist."""
        target = target.rstrip("/")
        if self.files.exists(target):
            raise InvalidInput(f"{target} exists")
        folders = []
        for f in self.version.folders:
            to = f"{target}/data/{f['path'].rsplit('/', 1)[1]}"
            self.files.copy(f["path"], to)
            folders.append({**f, "path": to})
        v = Version(**{**json.loads(self.version.to_json()), "number": 0, "folders": folders})
        self.files.create(f"{target}/manifest/{0:020d}.json", v.to_json())
        return Store(self.spark, target, self.merge)

    def export_cf(self, name: str, target: str) -> Store:
        """Like ``checkpoint``, with the rows of one column family alone."""
        if self.files.exists(target):
            raise InvalidInput(f"{target} exists")
        out = Store(self.spark, target, self.merge)
        rows = self.log(cfs=[self.cf(name)]).where(F.col("cf_id") == self.cf(name))
        out._commit(out._next(cfs={**out.version.cfs, name: self.cf(name)}, next_cf=self.version.next_cf))
        out.append_log(rows)
        return out

    def files_table(self) -> DataFrame:
        """FILES of this version, from the manifest alone: a row for each folder and column family."""
        unhex = lambda x: None if x is None else bytes.fromhex(x)
        rows = [
            (self.version.number, k, f["level"], s["cf_id"], s["size"], unhex(s["smallest"]), unhex(s["largest"]), s["smallest_seq"], s["largest_seq"], s["num_entries"], s["num_deletes"], s["num_merges"], s["num_range_dels"], f["created_at"])
            for k, f in enumerate(self.version.folders)
            for s in f["stats"]
        ]
        return self.spark.createDataFrame(rows, FILES)


class Backups:
    """Numbered copies of a store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, root)

    def list(self) -> list[int]:
        return [int(n) for n in self.files.names(self.root) if n.isdigit()]

    def create(self, store: Store) -> int:
        number = max(self.list(), default=0) + 1
        store.checkpoint(f"{self.root}/{number}")
        return number

    def restore(self, number: int, target: str) -> Store:
        if number not in self.list():
            raise NotFound(f"backup {number}")
        return Store(self.spark, f"{self.root}/{number}", read_only=True).checkpoint(target)

    def delete(self, number: int) -> None:
        if number not in self.list():
            raise NotFound(f"backup {number}")
        self.files.delete(f"{self.root}/{number}")

    def purge(self, keep: int) -> list[int]:
        gone = sorted(self.list())[: max(0, len(self.list()) - keep)]
        for n in gone:
            self.delete(n)
        return gone


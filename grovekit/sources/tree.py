"""Scans of a directory tree, mounted on all executors, into a manifest: as rounds of jobs, or as a data source."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from grovekit.functions.globs import Rule
from grovekit.functions.rulesets import RuleSet
from grovekit.staging import staged

SCHEMA = (
    "path binary, path_str string, kind string, size long, mtime_ns long, ctime_ns long, mode int, device long, inode long, uid long,"
    " gid long, nlink long, allocated_bytes long, symlink_target binary, has_xattrs boolean, error string"
)


def _shown(path: bytes) -> str:
    return path.decode("utf-8", "replace")


def _error(path: bytes, e: OSError) -> tuple:
    return path, _shown(path), *[None] * 13, f"{type(e).__name__}: {e.strerror}"


def _xattrs(full: bytes) -> bool | None:
    """Whether there are extended attributes; null where the system or the file system can't tell."""
    try:
        return bool(os.listxattr(full, follow_symlinks=False))
    except (AttributeError, OSError):
        return None


def _entry(root: bytes, path: bytes) -> tuple:
    full = os.path.join(root, path)
    try:
        s = os.lstat(full)
        m = s.st_mode
        kind = "file" if stat.S_ISREG(m) else "directory" if stat.S_ISDIR(m) else "symlink" if stat.S_ISLNK(m) else "other"
        target = os.readlink(full) if kind == "symlink" else None
        return (
            path, _shown(path), kind, s.st_size, s.st_mtime_ns, s.st_ctime_ns, stat.S_IMODE(m), s.st_dev, s.st_ino, s.st_uid, s.st_gid,
            s.st_nlink, s.st_blocks * 512, target, _xattrs(full), None,
        )
    except OSError as e:
        return _error(path, e)


class Entering:
    """Which directories a scan enters: not those given as pruned, and of the others those below which the rules may
    include something; with a prefix, those on its way and below it."""

    def __init__(self, pruned: Sequence[bytes] = (), rules: Sequence[Rule] = (), prefix: bytes = b""):
        self.pruned, self.rules, self.prefix, self._set = frozenset(pruned), tuple(rules), prefix, None

    def __call__(self, path: bytes) -> bool:
        below = path + b"/"
        if path in self.pruned or not (below.startswith(self.prefix) or self.prefix.startswith(below)):
            return False
        if not self.rules:
            return True
        self._set = self._set or RuleSet(self.rules)  # once a task
        return self._set.descend(_shown(path))

    def __getstate__(self):
        return self.__dict__ | {"_set": None}


def _listed(root: bytes, at: bytes) -> Iterator[tuple[bytes, bool]]:
    """(path, is a directory) of what a directory holds, as the system gives it, never all at once."""
    with os.scandir(os.path.join(root, at)) as names:
        for x in names:
            yield os.path.join(at, x.name), x.is_dir(follow_symlinks=False)


def walk(root: bytes, at: bytes, enter: Callable[[bytes], bool]) -> Iterator[tuple]:
    """Everything at and below a path; symlinks are reported and not followed; errors are rows."""
    yield _entry(root, at)
    if not os.path.isdir(os.path.join(root, at)) or os.path.islink(os.path.join(root, at)) or at and not enter(at):
        return
    left = [at]
    while left:
        here = left.pop()
        try:
            for path, is_dir in _listed(root, here):
                yield _entry(root, path)
                if is_dir and enter(path):
                    left.append(path)
        except OSError as e:
            yield _error(here, e)


# ---- in rounds -----------------------------------------------------------------------------------------------------

#: Names that a task lists from one directory of the frontier before it hands on the directories that it has found.
LIST_NAMES = 20_000
_BATCH = 10_000


def _frontier(root: bytes, enter: Entering, most: int):
    """Directories -> (path, state, error): `entry` of each name below, `open` of directories still to be listed. One
    directory is always listed whole, without being held; directories below it follow while fewer than `most` names were
    seen."""

    def rows(at: bytes) -> Iterator[tuple[bytes, str, str | None]]:
        left, seen = [at], 0
        while left:
            here = left.pop()
            if seen >= most:
                yield here, "open", None
                continue
            try:
                for path, is_dir in _listed(root, here):
                    seen += 1
                    yield path, "entry", None
                    if is_dir and enter(path):
                        left.append(path)
            except OSError as e:
                yield here, "error", f"{type(e).__name__}: {e.strerror}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for at in batch.column("path").to_pylist():
                for row in rows(at):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield _columns(held, pa.binary(), pa.string(), pa.string())
                        held = []
        if held:
            yield _columns(held, pa.binary(), pa.string(), pa.string())

    return run


def _columns(rows: list[tuple], *types: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["path", "state", "error"])


def _stat(root: bytes, fail: bool):
    types = [{"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in SCHEMA.split(",")]
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist()):
                row = _entry(root, path) if error is None else (path, _shown(path), *[None] * 13, error)
                if row[-1] and fail:
                    raise OSError(f"{row[1]}: {row[-1]}")
                rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def scan_tree(spark: SparkSession, root: str, rules: Sequence[Rule] = (), prune: Sequence[str] = (), mode: str = "FAILFAST", most: int = LIST_NAMES) -> DataFrame:
    """The entries below a directory, in the columns of SCHEMA.

    Listing goes in rounds over a frontier: the directories that are still to be listed stand in a written table, tasks
    list them and go on into what they find until they have seen `most` names, and hand on the rest as the next
    frontier. The names lie in tables from the start, so neither the number of directories nor the size of one bears on
    the driver; those of a single large directory are listed by one task as a stream. Afterwards all names are dealt
    out anew and looked at, so that the work on a large directory spreads too.

    With rules, directories below which none of them can include anything are reported and not entered; entries that the
    rules exclude are still reported elsewhere (see filter_decide). A link is reported and not followed. Errors are rows
    in the mode PERMISSIVE; in FAILFAST the first raises."""
    top = os.fsencode(root)
    enter = Entering([os.fsencode(p) for p in prune], rules)
    frontier, levels = spark.createDataFrame([(b"",)], "path binary"), []
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        level = staged(frontier.mapInArrow(_frontier(top, enter, most), "path binary, state string, error string"), "listed")
        levels.append(level.filter("state <> 'open'").select("path", "error"))
        frontier = level.filter("state = 'open'").select("path")
        left = frontier.count()
        if not left:
            break
        # a few directories a task at most, so that large ones don't wait for one another
        frontier = frontier.repartition(min(max(width, left // 64), left))
    names = levels[0]
    for level in levels[1:]:
        names = names.unionByName(level)
    return names.repartition(width).mapInArrow(_stat(top, mode.upper() == "FAILFAST"), SCHEMA)


# ---- contents ------------------------------------------------------------------------------------------------------

CHUNK_BYTES = 4 << 20


def content_chunks(files: DataFrame, root: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """path, offset, content: the contents of files(path, size) below the root in rows of `chunk` bytes, an empty file in
    an empty row. No row is larger, whatever the file's size; the rows of one file are read by many tasks. A file that is
    shorter by now gives shorter rows, which chunk_digests() finds."""
    top = os.fsencode(root)
    last = F.greatest(F.col("size") - 1, F.lit(0).cast("long"))
    starts = files.select(F.col("path").cast("binary").alias("path"), F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(chunk).cast("long"))).alias("offset"), "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "size")]):
                with open(os.path.join(top, path), "rb") as f:
                    f.seek(offset)
                    content = f.read(min(chunk, size - offset))
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([offset]), pa.array([content], pa.binary())], ["path", "offset", "content"])

    return starts.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, "path binary, offset long, content binary")


# ---- as a data source ----------------------------------------------------------------------------------------------

#: Directories are listed for planning, down to so many levels, until there are as many partitions; of a directory with
#: more names than LOOK none is kept, and it is one partition.
PARTITIONS, LEVELS, LOOK, OWN_DIRECTORIES = 256, 4, 4096, 64


class _Part(InputPartition):
    """Directories, read with all below them or with what they hold besides directories that are entered."""

    def __init__(self, paths: list[bytes], below: bool):
        self.paths, self.below = paths, below


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.fsencode(options["path"])
        self.fail = options.get("mode", "FAILFAST").upper() == "FAILFAST"
        rules = [Rule(**x) for x in json.loads(options.get("rules", "[]"))]
        self.enter = Entering([os.fsencode(x) for x in options.get("prune", "").split("\n") if x], rules)

    def _directories(self, at: bytes) -> list[bytes] | None:
        """The directories to be entered that it holds; none if it can't be listed or holds too much for planning."""
        found = []
        try:
            for n, (path, is_dir) in enumerate(_listed(self.root, at)):
                if n >= LOOK:
                    return None
                if is_dir and self.enter(path):
                    found.append(path)
        except OSError:
            return None  # reading it says what is wrong
        return found

    def partitions(self):
        if not os.path.isdir(self.root):
            return [_Part([], False)]
        own, whole, open_ = [], [], [b""]
        for _ in range(LEVELS):
            found = []
            for at in open_:
                inside = self._directories(at)
                if inside is None:
                    whole.append(at)
                else:
                    own.append(at)
                    found += inside
            open_ = found
            if not open_ or len(open_) >= PARTITIONS:
                break
        parts = [_Part([path], True) for path in sorted(whole + open_)]
        return parts + [_Part(own[k : k + OWN_DIRECTORIES], False) for k in range(0, len(own), OWN_DIRECTORIES)]

    def _rows(self, partition) -> Iterator[tuple]:
        if not partition.paths:  # a single file: its own name
            yield _entry(os.path.dirname(self.root), os.path.basename(self.root))
        for at in partition.paths:
            if partition.below:
                yield from (row for row in walk(self.root, at, self.enter) if row[0] or row[-1])
                continue
            if at:
                yield _entry(self.root, at)
            try:
                yield from (_entry(self.root, path) for path, is_dir in _listed(self.root, at) if not is_dir or not self.enter(path))
            except OSError as e:
                yield _error(at, e)

    def read(self, partition):
        for row in self._rows(partition):
            if row[-1] and self.fail:
                raise OSError(f"{row[1]}: {row[-1]}")
            yield row


class _PushedReader(_Reader):
    """With filters on path_str that begin it or name it, only directories on the way there are entered."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path_str",) and "�" not in f.value:
                prefix = os.fsencode(f.value)
                if len(prefix) > len(self.enter.prefix):
                    self.enter.prefix = prefix
        yield from filters  # Spark still applies them to the rows


class TreeDataSource(DataSource):
    """spark.dataSource.register(TreeDataSource); spark.read.format("tree").load(path).

    Options: mode (FAILFAST, or PERMISSIVE for error rows); prune (directories not to be entered, a line each); rules (as
    rules_option() writes them: directories below which nothing can be included aren't entered); pushdown (true: filters
    on path_str prune too, for which Spark's spark.sql.python.filterPushdown.enabled must be on). Planning lists upper
    directories in the driver, small ones only; scan_tree() lists all of a tree on the executors."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (_PushedReader if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options)


def rules_option(rules: Sequence[Rule]) -> str:
    return json.dumps([vars(r) for r in rules])


def digest_tree(files: DataFrame, root: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """path, size, digest, fault of files(path, size) below the root, by content_chunks() and chunk_digests()."""
    from grovekit.operators.verifying import chunk_digests

    return chunk_digests(content_chunks(files, root, chunk), files.select(F.col("path").cast("binary").alias("path"), "size"))

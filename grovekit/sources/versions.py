"""Tables published as numbered versions, and a digest cache of numbered commits.

A version is a folder that is written beside the others and then renamed to the next number. The rename fails if another
publisher has taken that number, so it is a compare-and-swap: whoever loses is told so and has changed nothing. A reader
takes the highest number; there is always one, and it never changes while it is read. HDFS and mounted folders have such
a rename; on an object store without one use a table format instead."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.operators.requests import publish_cas, publish_requests
from grovekit.operators.verifying import digest_cache_lookup
from grovekit.staging import scratch, staged


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, mark: str) -> list[int]:
    """The numbers of the folders mark-<number>, rising."""
    path, fs = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted(int(n[len(mark) + 1 :]) for n in names if n.startswith(f"{mark}-") and n[len(mark) + 1 :].isdigit())


def _name(mark: str, number: int) -> str:
    return f"{mark}-{number:012d}"


def _take(spark: SparkSession, folder: str, stage: str, mark: str, number: int) -> bool:
    """Renames a staged folder to the number; false, and nothing changed, if the number is taken.

    A staged folder holds files, so the system's own rename fails on another one. Hadoop's local file system would copy
    into it instead, so mounted folders are renamed by Java's."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    path, fs = _file_system(spark, folder)
    old, put = jvm.org.apache.hadoop.fs.Path(path, stage), jvm.org.apache.hadoop.fs.Path(path, _name(mark, number))
    try:
        if fs.getUri().getScheme() == "file":
            options = new_array(jvm.java.nio.file.CopyOption, 1)
            options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(*(jvm.java.io.File(x.toUri().getPath()).toPath() for x in (old, put)), options)
        else:
            options = new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(old, put, options)
        return True
    except Exception:
        if number in _numbers(spark, folder, mark):
            return False
        raise


def _measured(df: DataFrame):
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()


def _staged_beside(df: DataFrame, folder: str, retries: int) -> str:
    """The name of a folder that holds df, read back and compared; one more try if it differs."""
    spark = df.sparkSession
    want = None
    for _ in range(retries + 1):
        name = f"_stage-{uuid.uuid4().hex}"
        df.write.parquet(f"{folder.rstrip('/')}/{name}")
        want = want or _measured(df)
        if _measured(spark.read.parquet(f"{folder.rstrip('/')}/{name}")) == want:
            return name
        _delete(spark, folder, name)
    raise OSError(f"what was written to {folder} is not what was to be written")


def _delete(spark: SparkSession, folder: str, name: str) -> None:
    path, fs = _file_system(spark, folder)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name), True)


# ---- published tables ----------------------------------------------------------------------------------------------


def current_version(spark: SparkSession, target: str) -> int:
    """The highest version's number, 0 before the first."""
    return max(_numbers(spark, target, "v"), default=0)


def read_version(spark: SparkSession, target: str, number: int | None = None) -> DataFrame:
    """A version of a published table, the current one unless told otherwise."""
    number = number or current_version(spark, target)
    if not number:
        raise FileNotFoundError(f"nothing was published at {target}")
    return spark.read.parquet(f"{target.rstrip('/')}/{_name('v', number)}")


def publish_version(df: DataFrame, target: str, base: int | None = None, retries: int = 1) -> str:
    """Puts df in the place of version `base` (by default the current one): `ok`, or `changed` if there is another by now.

    df is written beside, read back, and compared by count and digest of its rows before it gets its number. It may be made
    from the table's own current version, which stays."""
    spark = df.sparkSession
    base = current_version(spark, target) if base is None else base
    stage = _staged_beside(df, target, retries)
    if _take(spark, target, stage, "v", base + 1):
        return "ok"
    _delete(spark, target, stage)
    return "changed"


def drop_versions(spark: SparkSession, target: str, keep: int = 2) -> None:
    """Removes all but the latest `keep` versions, when nobody reads the others any more."""
    for number in _numbers(spark, target, "v")[: -max(keep, 1)]:
        _delete(spark, target, _name("v", number))


def apply_requests(requests: DataFrame, target: str, attempts: int = 3) -> DataFrame:
    """Publishes the requests that publish_cas() lets through as a new version: req_id, path, status, current_identity.

    Requests are held against the version that theirs is to follow. If another publisher comes between, they are held
    against the new one again, and those whose file has changed are told so."""
    spark = requests.sparkSession
    for _ in range(attempts):
        base = current_version(spark, target)
        current = read_version(spark, target, base)
        status = staged(publish_cas(requests, current), "request-status")
        if not status.filter("status = 'ok'").limit(1).count():
            return status
        if publish_version(publish_requests(requests, current), target, base) == "ok":
            return status
    raise OSError(f"{target} changed {attempts} times meanwhile")


# ---- a cache of digests --------------------------------------------------------------------------------------------

CACHE = "fingerprint string, digest string"
#: Digests that are worked out between two commits, about.
COMMIT_ROWS = 5_000_000
#: Commits of one run. A commit takes a few jobs however few its rows, so a run of more misses makes larger ones.
MOST_COMMITS = 32


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """fingerprint, digest of all commits since the last compaction. Files that can't be read, or not in this schema, and
    rows that hold no digest are left out: their contents are digested anew, and the next compaction drops them."""
    base = max(_numbers(spark, cache, "base"), default=0)
    folders = [_name("base", base)] * bool(base) + [_name("commit", n) for n in _numbers(spark, cache, "commit") if n > base]
    found = spark.createDataFrame([], CACHE)
    if folders:
        reader = spark.read.schema(CACHE).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        found = reader.parquet(*[f"{cache.rstrip('/')}/{x}" for x in folders])
    return found.filter("fingerprint is not null and digest rlike '^[0-9a-f]{64}$'")


def commit_digests(found: DataFrame, cache: str) -> int:
    """Appends found(fingerprint, digest) as the next commit and gives its number. Commits of several runs at a time all
    stand: who finds a number taken takes the next. found is worked out once; what is compared is its written rows."""
    spark = found.sparkSession
    stage = _staged_beside(staged(found.select("fingerprint", "digest"), "digests"), cache, 1)
    while True:
        number = max([*_numbers(spark, cache, "commit"), *_numbers(spark, cache, "base")], default=0) + 1
        if _take(spark, cache, stage, "commit", number):
            return number


def compact_cache(spark: SparkSession, cache: str) -> int:
    """Writes what can be read as one base, each fingerprint once, and drops the commits that it replaces; the number of
    rows. Commits that come meanwhile have higher numbers and stay."""
    commits, bases = _numbers(spark, cache, "commit"), _numbers(spark, cache, "base")
    number = max([*commits, *bases], default=0)
    if not number:
        return 0
    whole = staged(read_cache(spark, cache).groupBy("fingerprint").agg(F.max("digest").alias("digest")), "compacted")
    if commits:
        stage = _staged_beside(whole, cache, 1)
        if not _take(spark, cache, stage, "base", number):
            _delete(spark, cache, stage)  # another run has compacted as far
        for mark, old in [*(("commit", n) for n in commits), *(("base", n) for n in bases if n < number)]:
            _delete(spark, cache, _name(mark, old))
    return whole.count()


def digests_by_cache(entries: DataFrame, cache: str, digest: Callable[[DataFrame], DataFrame], commit_rows: int = COMMIT_ROWS) -> DataFrame:
    """entries(.., fingerprint) with digest and hit: cached ones as they are; of the others each fingerprint once goes to
    `digest`, which takes and returns rows with its fingerprint. They go in batches of about commit_rows, or of a
    MOST_COMMITS-th of all where that is more. Each is committed before the next, so a run that is lost keeps all but its
    last batch. The misses are dealt to a folder a batch, and a batch reads its own alone; it isn't held against the cache
    again: what another run has committed meanwhile stands twice until the next compaction, and is read once."""
    spark = entries.sparkSession
    looked = staged(digest_cache_lookup(entries, read_cache(spark, cache)), "looked-up")
    missed = looked.filter("not hit").drop("cached_digest", "hit")
    batches = min(-(-missed.select("fingerprint").distinct().count() // commit_rows), MOST_COMMITS)
    if batches:
        folder = scratch(spark, "misses")
        dealt = missed.dropDuplicates(["fingerprint"]).withColumn("_batch", F.pmod(F.xxhash64("fingerprint"), F.lit(batches)))
        dealt.repartitionByRange("_batch", "fingerprint").write.partitionBy("_batch").parquet(folder)
        misses = spark.read.schema(dealt.schema).parquet(folder)
        for k in range(batches):
            found = digest(misses.filter(F.col("_batch") == k).drop("_batch"))
            commit_digests(found.groupBy("fingerprint").agg(F.max("digest").alias("digest")), cache)
    known = read_cache(spark, cache).groupBy("fingerprint").agg(F.max("digest").alias("digest"))
    hits = looked.select(*[F.col(c) for c in entries.columns if c != "digest"], "hit")
    return hits.join(known, "fingerprint", "left")

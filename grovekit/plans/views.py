"""Manifests, ranges, events and measurements made from a star schema's tables, in Spark and in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.globs import Rule
from grovekit.operators.trees import with_directories


def bucket(salt: str, key: Column) -> Column:
    """A number below 100 by a salted hash."""
    digest = F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % 100


def _bucket_sql(salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(sha256('{salt}' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) % 100)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.format_string("%s/%s/doc-%06d.txt", "source", "lang", "doc_id").alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 60_000_000_000).alias("mtime_ns"),
        F.lit(420).alias("mode"),
        F.sha2("text", 256).alias("digest"),
        bucket("dst:", F.col("doc_id")).alias("b"),
    )


def src(spark, sf_dir):
    return _entries(spark, sf_dir).filter("b < 95").drop("b")


def dst(spark, sf_dir):
    e, b = _entries(spark, sf_dir).filter("b >= 5"), F.col("b")
    late = F.when(b.between(10, 14), 60_000_000_000).when(b.between(25, 29), 500_000_000).otherwise(0).cast("long")
    return e.withColumns(
        {
            "mtime_ns": F.col("mtime_ns") + late,
            "mode": F.when(b.between(15, 19), 384).otherwise(F.col("mode")),
            "kind": F.when(b.between(20, 24), "directory").otherwise(F.col("kind")),
            "digest": F.when(b.between(30, 32), F.sha2("digest", 256)).otherwise(F.col("digest")),
        }
    ).drop("b")


def src_tree(spark, sf_dir):
    return with_directories(src(spark, sf_dir))


def dst_tree(spark, sf_dir):
    return with_directories(dst(spark, sf_dir).filter("kind = 'file'"))


def content(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.format_string("%s/%s/doc-%06d.txt", "source", "lang", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


def ranges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("path"), (F.col("l_partkey") % 64 * 1048576).cast("long").alias("offset"), (F.col("l_quantity").cast("long") * 65536).alias("length"))


def range_files(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path")).distinct().withColumn("size", F.lit(96 << 20).cast("long"))


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t, n = F.col("event_type"), F.col("event_id") % 4
    kind = F.when(t == "view", "progress").when(t == "click", "transferred").when(t == "error", "failed").when(t.isin("signup", "purchase"), "phase").otherwise("other")
    name = F.when(t.isin("signup", "purchase"), F.element_at(F.array(*[F.lit(x) for x in ("scan", "plan", "transfer", "metadata")]), (n + 1).cast("int")))
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("run_id"),
        kind.alias("type"),
        name.alias("name"),
        F.when(t.isin("signup", "purchase"), t == "signup").alias("started"),
        (F.unix_micros(ts) * 1000).alias("ts_nanos"),
        F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("path"),
        F.floor(F.col("value") * 1000).cast("long").alias("completed"),
        ts.alias("ts"),
        F.col("event_id").alias("event_id"),
    )


def samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m, rep = F.col("l_linenumber") % 3, (F.col("l_orderkey") % 5).cast("int")
    grouped = li.groupBy(m.alias("m"), rep.alias("repetition")).agg(
        F.round(F.avg(0.5 + F.col("l_tax")), 9).alias("wall_seconds"),
        F.round(F.avg("l_discount"), 9).alias("cpu_seconds"),
        F.max("l_partkey").alias("peak_rss_bytes"),
        F.lit(7).cast("long").alias("item_count"),
        F.count("*").alias("logical_bytes"),
        F.sum(F.col("l_quantity").cast("long")).alias("allocated_bytes"),
        F.sum("l_suppkey").alias("wire_bytes"),
    )
    order = ((F.col("m") + F.col("repetition")) % 3).cast("int")
    phases = F.map_from_arrays(F.array(F.lit("scan"), F.lit("transfer")), F.array(F.col("wall_seconds") * 0.25, F.col("wall_seconds") * F.when(F.col("m") == 1, 0.5).otherwise(0.74)))
    return grouped.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("result"),
        F.when(F.col("m") > 0, "m0").alias("baseline"),
        "repetition", order.alias("method_order"), "wall_seconds", "cpu_seconds", "peak_rss_bytes", "item_count", "logical_bytes", "allocated_bytes", "wire_bytes",
        phases.alias("phases"),
    )


def gate_samples(spark, sf_dir):
    """Samples of seven results (the rows of a line number each) in five repetitions, with what an oracle said of them."""
    li = table(spark, sf_dir, "lineitem")
    m, rep = F.col("l_linenumber") % 7, (F.col("l_orderkey") % 5).cast("int")
    rows = li.groupBy(m.alias("m"), rep.alias("repetition")).agg(F.round(F.avg(0.5 + F.col("l_tax")), 9).alias("wall"), F.round(F.avg("l_discount"), 9).alias("cpu_seconds"), F.count("*").alias("n"))
    wall = F.when(F.col("m") == 5, F.col("wall") * (1 + F.col("repetition"))).otherwise(F.col("wall"))
    one = F.lit(1).cast("long")
    rows = rows.withColumn("bytes", F.when(F.col("m") == 6, F.col("n") * 10 + F.col("repetition")).otherwise(one * 100)).withColumn("items", one * 7)
    oracle = F.struct(
        (F.col("m") != 3).alias("passed"), F.lit(0).cast("long").alias("mismatch_count"), F.lit("c").alias("expected_digest"), F.lit("c").alias("actual_digest"),
        F.when(F.col("m") == 2, F.col("items") + 1).otherwise(F.col("items")).alias("item_count"), F.col("bytes").alias("logical_bytes"),
    )
    return rows.select(
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("result"), F.when(F.col("m") > 0, "m0").alias("baseline"), "repetition",
        F.when(F.col("m") == 4, F.lit(9)).otherwise((F.col("m") + F.col("repetition")) % 7).cast("int").alias("method_order"), wall.alias("wall_seconds"), "cpu_seconds",
        F.col("n").alias("peak_rss_bytes"), F.col("items").alias("item_count"), F.col("bytes").alias("logical_bytes"), F.col("n").alias("allocated_bytes"), F.col("n").alias("wire_bytes"),
        F.create_map(F.lit("scan"), wall).alias("phases"), oracle.alias("oracle"),
    )


def inodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.format_string("%s/%s/doc-%06d.txt", "source", "lang", "doc_id").alias("path"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("device"),
        (F.col("doc_id") % 700).alias("inode"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1000).cast("long").alias("uid"),
        (F.col("doc_id") % 25 == 0).alias("has_xattrs"), (F.col("doc_id") % 13 * 512).alias("allocated_bytes"), (F.col("doc_id") % 17 == 0).alias("is_placeholder"),
    )
    n = rows.groupBy("device", "inode").agg(F.count("*").alias("nlink"))
    return rows.join(n, ["device", "inode"])


def collisions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    return p.select("path").unionByName(p.filter("page_id % 50 = 0").select(F.upper("path").alias("path"))).distinct()


def odd_paths(spark, sf_dir):
    p, n = F.regexp_replace("url", "^https?://", ""), F.col("page_id") % 8
    path = (
        F.when(n == 1, F.concat(F.lit("/"), p)).when(n == 2, F.concat(p, F.lit("/"))).when(n == 3, F.replace(p, F.lit("/"), F.lit("//"))).when(n == 4, F.concat(p, F.lit("/../x")))
        .when(n == 5, "").when(n == 6, F.concat(p, F.lit("/./y"))).when(n == 7, F.concat(p, F.lit("/.hidden/..b"))).otherwise(p)
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n, p = F.col("doc_id") % 6, F.format_string("%s/%s/doc-%06d.txt", "source", "lang", "doc_id")
    op = F.element_at(F.array(*[F.lit(x) for x in ("rename", "rename", "mkdir", "chmod", "delete", "set_mtime")]), (n + 1).cast("int"))
    path = F.when(n == 2, F.concat_ws("/", "source", "lang", F.concat(F.lit("new-"), F.col("doc_id").cast("string")))).otherwise(p)
    dest = F.when(n == 0, F.concat_ws("/", "source", "lang", F.concat(F.lit("moved-"), F.col("doc_id").cast("string")))).when(n == 1, F.concat(F.lit("nowhere/x"), F.col("doc_id").cast("string")))
    return d.select(F.col("doc_id").alias("req_id"), op.alias("op"), path.alias("path"), dest.alias("dest"))


RULES = (
    Rule(0, 1, "include", "src0/fr/**", origin="command line:1"),
    Rule(0, 2, "exclude", "src0/**", origin="command line:2"),
    Rule(0, 3, "exclude", "*-00001?.txt", origin="command line:3"),
    Rule(0, 4, "exclude", "src1/{de,es}/**", origin="command line:4"),
    Rule(0, 5, "exclude", "src2", origin="command line:5"),
    Rule(1, 1, "include", "doc-*5.txt", "src3/en", "src3/en/.ignore:1"),
    Rule(1, 2, "exclude", "doc-*[0-9].txt", "src3/en", "src3/en/.ignore:2"),
    Rule(1, 1, "exclude", "*/doc-*7.txt", "src3", "src3/.ignore:1"),
)


def rule_rows(rules) -> str:
    return ", ".join(f"({r.tier}, '{r.scope}', {r.ord}, '{r.action}', '{r.pattern}', '{r.regex}', '{r.origin}')" for r in rules)


def _rules_sql() -> str:
    return f"SELECT * FROM (VALUES {rule_rows(RULES)}) AS t(tier, scope, ord, action, pattern, regex, origin)"


_PATH = "printf('%s/%s/doc-%06d.txt', source, lang, doc_id)"
_TREE = """SELECT * FROM {0} UNION ALL SELECT a, 'directory', 0, 0, 493, NULL FROM (SELECT DISTINCT array_to_string(parts[1:i], '/') AS a FROM
 (SELECT parts, unnest(range(1, len(parts))) AS i FROM (SELECT string_split(path, '/') AS parts FROM {0}))) WHERE a NOT IN (SELECT path FROM {0})"""
#: SQL of the views, each after those that it uses.
SQL: dict[str, str] = {
    "e0": f"SELECT {_PATH} AS path, 'file' AS kind, CAST(strlen(text) AS BIGINT) AS size, doc_id * 60000000000 AS mtime_ns, 420 AS mode, sha256(text) AS digest, {_bucket_sql('dst:', 'doc_id')} AS b FROM documents",
    "src": "SELECT * EXCLUDE (b) FROM e0 WHERE b < 95",
    "dst": """SELECT path, CASE WHEN b BETWEEN 20 AND 24 THEN 'directory' ELSE kind END AS kind, size,
 mtime_ns + CASE WHEN b BETWEEN 10 AND 14 THEN 60000000000 WHEN b BETWEEN 25 AND 29 THEN 500000000 ELSE 0 END AS mtime_ns,
 CASE WHEN b BETWEEN 15 AND 19 THEN 384 ELSE mode END AS mode, CASE WHEN b BETWEEN 30 AND 32 THEN sha256(digest) ELSE digest END AS digest FROM e0 WHERE b >= 5""",
    "src_tree": _TREE.format("src"),
    "dst_f": "SELECT * FROM dst WHERE kind = 'file'",
    "dst_tree": _TREE.format("dst_f"),
    "content": f"SELECT {_PATH} AS path, text AS content FROM documents",
    "ranges": "SELECT CAST(l_orderkey AS VARCHAR) AS path, l_partkey % 64 * 1048576 AS off, CAST(l_quantity AS BIGINT) * 65536 AS len FROM lineitem",
    "range_files": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, CAST(100663296 AS BIGINT) AS size FROM lineitem",
    "ev": """SELECT user_id AS run_id, CASE event_type WHEN 'view' THEN 'progress' WHEN 'click' THEN 'transferred' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'phase' WHEN 'purchase' THEN 'phase' ELSE 'other' END AS type,
 CASE WHEN event_type IN ('signup', 'purchase') THEN ['scan', 'plan', 'transfer', 'metadata'][event_id % 4 + 1] END AS name,
 CASE WHEN event_type IN ('signup', 'purchase') THEN event_type = 'signup' END AS started, epoch_us(ts) * 1000 AS ts_nanos, 'p' || CAST(event_id % 50 AS VARCHAR) AS path,
 CAST(floor(value * 1000) AS BIGINT) AS completed, ts, event_id FROM events""",
    "samples": """SELECT 'm' || CAST(m AS VARCHAR) AS result, CASE WHEN m > 0 THEN 'm0' END AS baseline, repetition, CAST((m + repetition) % 3 AS INTEGER) AS method_order, wall_seconds, cpu_seconds,
 peak_rss_bytes, item_count, logical_bytes, allocated_bytes, wire_bytes, wall_seconds * 0.25 AS p_scan, wall_seconds * CASE WHEN m = 1 THEN 0.5 ELSE 0.74 END AS p_transfer FROM
 (SELECT l_linenumber % 3 AS m, CAST(l_orderkey % 5 AS INTEGER) AS repetition, round(avg(0.5 + l_tax), 9) AS wall_seconds, round(avg(l_discount), 9) AS cpu_seconds, max(l_partkey) AS peak_rss_bytes,
 CAST(7 AS BIGINT) AS item_count, count(*) AS logical_bytes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS allocated_bytes, CAST(sum(l_suppkey) AS BIGINT) AS wire_bytes FROM lineitem GROUP BY 1, 2)""",
    "gsamples": """SELECT 'm' || CAST(m AS VARCHAR) AS result, CASE WHEN m > 0 THEN 'm0' END AS baseline, repetition, CASE WHEN m = 4 THEN 9 ELSE (m + repetition) % 7 END AS method_order,
 CASE WHEN m = 5 THEN wall * (1 + repetition) ELSE wall END AS wall_seconds, CASE WHEN m = 6 THEN n * 10 + repetition ELSE 100 END AS logical_bytes
 FROM (SELECT l_linenumber % 7 AS m, CAST(l_orderkey % 5 AS INTEGER) AS repetition, round(avg(0.5 + l_tax), 9) AS wall, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "inodes": f"""SELECT {_PATH} AS path, 'file' AS kind, CAST(1 AS BIGINT) AS device, doc_id % 700 AS inode, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1000 END AS uid,
 doc_id % 25 = 0 AS has_xattrs, doc_id % 13 * 512 AS allocated_bytes, doc_id % 17 = 0 AS is_placeholder, count(*) OVER (PARTITION BY doc_id % 700) AS nlink FROM documents""",
    "coll": "SELECT DISTINCT path FROM (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages UNION ALL SELECT upper(regexp_replace(url, '^https?://', '')) FROM pages WHERE page_id % 50 = 0)",
    "odd": """SELECT page_id, CASE page_id % 8 WHEN 1 THEN '/' || p WHEN 2 THEN p || '/' WHEN 3 THEN replace(p, '/', '//') WHEN 4 THEN p || '/../x' WHEN 5 THEN '' WHEN 6 THEN p || '/./y'
 WHEN 7 THEN p || '/.hidden/..b' ELSE p END AS path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""",
    "req": f"""SELECT doc_id AS req_id, ['rename', 'rename', 'mkdir', 'chmod', 'delete', 'set_mtime'][doc_id % 6 + 1] AS op,
 CASE WHEN doc_id % 6 = 2 THEN source || '/' || lang || '/new-' || CAST(doc_id AS VARCHAR) ELSE {_PATH} END AS path,
 CASE doc_id % 6 WHEN 0 THEN source || '/' || lang || '/moved-' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'nowhere/x' || CAST(doc_id AS VARCHAR) END AS dest FROM documents""",
    "rules": _rules_sql(),
    # the plan of src against dst
    "plan": """SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL THEN d.kind ELSE s.kind END AS kind, CASE WHEN s.path IS NULL THEN d.size ELSE s.size END AS size,
 CASE WHEN s.path IS NULL THEN d.mtime_ns ELSE s.mtime_ns END AS mtime_ns, CASE WHEN s.path IS NULL THEN d.mode ELSE s.mode END AS mode, CASE WHEN s.path IS NULL THEN d.digest ELSE s.digest END AS digest,
 CASE WHEN d.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'extraneous' WHEN s.kind <> d.kind OR s.size <> d.size OR s.mtime_ns // 1000000000 <> d.mtime_ns // 1000000000 THEN 'changed'
 WHEN s.kind IN ('file', 'directory') AND s.mode <> d.mode THEN 'metadata_only' ELSE 'unchanged' END AS classification,
 d.kind AS d_kind, d.size AS d_size, d.mtime_ns AS d_mtime, d.mode AS d_mode, d.digest AS d_digest FROM src s FULL OUTER JOIN dst d ON s.path = d.path""",
    "tplan": """SELECT coalesce(s.path, d.path) AS path, CASE WHEN s.path IS NULL THEN d.kind ELSE s.kind END AS kind, CASE WHEN s.path IS NULL THEN d.size ELSE s.size END AS size,
 CASE WHEN d.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'extraneous' WHEN s.kind <> d.kind OR s.size <> d.size OR s.mtime_ns // 1000000000 <> d.mtime_ns // 1000000000 THEN 'changed'
 WHEN s.mode <> d.mode THEN 'metadata_only' ELSE 'unchanged' END AS classification FROM src_tree s FULL OUTER JOIN dst_tree d ON s.path = d.path""",
    # (path, ancestor, distance) of the source tree, itself at 0
    "anc": """SELECT path, array_to_string(parts[1:len(parts) - dist], '/') AS ancestor, dist FROM (SELECT path, parts, unnest(range(0, len(parts))) AS dist FROM (SELECT path, string_split(path, '/') AS parts FROM src))""",
    "tanc": """SELECT path, array_to_string(parts[1:len(parts) - dist], '/') AS ancestor, dist FROM (SELECT path, parts, unnest(range(0, len(parts))) AS dist FROM (SELECT path, string_split(path, '/') AS parts FROM tplan))""",
    "merged": """SELECT path, min(off) AS off, max(off + len) AS fin FROM (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY off, len ROWS UNBOUNDED PRECEDING) AS island FROM
 (SELECT *, CASE WHEN seen IS NULL OR off >= seen THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(off + len) OVER (PARTITION BY path ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
 FROM ranges WHERE len > 0))) GROUP BY path, island""",
    "decided": """SELECT path, action, pattern, origin, via FROM (SELECT a.path, r.action, r.pattern, r.origin, a.ancestor AS via,
 row_number() OVER (PARTITION BY a.path ORDER BY tier, dist, -length(scope), ord) AS rn FROM anc a JOIN rules r
 ON CASE WHEN scope = '' THEN regexp_matches(a.ancestor, regex) ELSE starts_with(a.ancestor, scope || '/') AND regexp_matches(substr(a.ancestor, length(scope) + 2), regex) END) WHERE rn = 1""",
}


def with_views(sql: str) -> str:
    """A statement with the views that it names, and those that they name, before it."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                add(SQL[name])
                need.append(name)

    add(sql)
    if not need:
        return sql
    own = re.match(r"WITH( RECURSIVE)?\s+", sql)
    views = ",\n".join(f"{n} AS ({SQL[n]})" for n in need)
    return f"WITH{own[1] or ''} {views},\n{sql[own.end() :]}" if own else f"WITH {views}\n{sql}"


View = Callable[[SparkSession, str], DataFrame]

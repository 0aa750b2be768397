"""The schemas of the library's tables."""

ENTRIES = (
    "tree_id string, path string, kind string, size long, mtime_ns long, mode int, device long, inode long, ctime_ns long,"
    " uid long, gid long, nlink long, allocated_bytes long, symlink_target binary, digest string, is_placeholder boolean, has_xattrs boolean"
)
RULES = "tier int, scope string, ord int, action string, pattern string, regex string, origin string"
RANGES = "path string, offset long, length long"
WORK_ITEMS = "item_kind string, batch_id long, path string, offset long, length long, stream_id long"
EVENTS = (
    "run_id long, type string, schema_version int, timestamp_unix_nanos long, name string, started boolean, path string,"
    " completed long, total long, message string"
)
FAILURES = "schema_version int, type string, timestamp_unix_nanos long, origin string, kind string, pid long, message string, path string, host string"
MANIFEST = (
    "schema string, path_encoding string, digest_algorithm string, item_count long, logical_bytes long, allocated_bytes long, manifest_digest string,"
    " entries array<struct<path: struct<components_hex: array<string>>, kind: string, length: long, allocated_bytes: long, content_digest: string,"
    " mode: int, mtime: struct<seconds: long, nanoseconds: long>, symlink_target_hex: string>>"
)
SAMPLE = (
    "struct<repetition: int, method_order: int, wall_seconds: double, cpu_seconds: double, peak_rss_bytes: long, item_count: long,"
    " logical_bytes: long, source_allocated_bytes: long, destination_allocated_bytes: long, wire_bytes: long, phases_seconds: map<string, double>,"
    " cache_state: string, cache_eviction_method: string, setup_seconds: double, oracle: struct<passed: boolean, mismatch_count: long, expected_digest: string, actual_digest: string, item_count: long, logical_bytes: long>>"
)
BENCH_INPUT = (
    "schema string, build string, environment string, session string, corpus struct<id: string, digest: string>, tools array<string>,"
    f" results array<struct<name: string, baseline: string, samples: array<{SAMPLE}>>>"
)

"""Statistics of paired measurements, and the gate that compares two reports.

samples(result, baseline, repetition, method_order, wall_seconds, cpu_seconds, peak_rss_bytes, item_count,
logical_bytes, allocated_bytes, wire_bytes, phases map); some operators also read result_number, setup_seconds,
cache_state, cache_eviction_method and oracle(passed, mismatch_count, expected_digest, actual_digest, item_count,
logical_bytes) where samples have them. A result has one sample for each repetition, few of them, so the medians of a
result are taken from one array of its repetitions: one aggregation, whatever is asked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.functions import scalars as S

# The gate's limits.
LEAST_REPETITIONS, NOISE_LIMIT, TOLERANCE, UNACCOUNTED = 5, 0.15, 0.15, 0.05


def upper_median(name: str) -> Column:
    """The middle one, of an even number the upper: integers stay integers."""
    return F.expr(f"cast(percentile_disc(0.5) within group (order by `{name}` desc) as bigint)")


def array_median(values: Column) -> Column:
    """The median of an array of numbers; null for none."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.element_at(ordered, (F.floor(i) + 1).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def array_mad(values: Column, median: Column) -> Column:
    return array_median(F.transform(values, lambda x: F.abs(x - median)))


def pair_with_baseline(samples: DataFrame) -> DataFrame:
    """result, repetition, speedup against the baseline's sample of the same repetition."""
    base = samples.select(F.col("result").alias("baseline"), "repetition", F.col("wall_seconds").alias("_base"), F.col("method_order").alias("_order"))
    return samples.filter("baseline is not null").join(base, ["baseline", "repetition"]).select(
        "result", "baseline", "repetition", S.speedup(F.col("_base"), F.col("wall_seconds")).alias("speedup"), (F.col("method_order") < F.col("_order")).alias("before_baseline")
    )


def measured(samples: DataFrame) -> DataFrame:
    """A row per result: baseline, runs (repetition, wall, order), repetitions, median_wall, mad_wall, noise_ratio, the
    baseline's base_runs and base_noise, median_speedup, speedup_mad, speedup_noise; items_differ, oracle_failed and
    counts_differ (of samples without an oracle: false). One aggregation and one join of its few rows with themselves."""
    has = "oracle" in samples.columns
    o = lambda name: F.col(f"oracle.{name}")
    failed = ~F.coalesce(o("passed"), F.lit(False)) | (o("mismatch_count") != 0) | ~o("expected_digest").eqNullSafe(o("actual_digest")) if has else F.lit(False)
    unlike = (F.col("item_count") != o("item_count")) | (F.col("logical_bytes") != o("logical_bytes")) if has else F.lit(False)
    each = samples.groupBy("result").agg(
        F.first("baseline", ignorenulls=True).alias("baseline"),
        F.array_sort(F.collect_list(F.struct("repetition", F.col("wall_seconds").alias("wall"), F.col("method_order").alias("order")))).alias("runs"),
        ((F.min("item_count") != F.max("item_count")) | (F.min("logical_bytes") != F.max("logical_bytes"))).alias("items_differ"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("oracle_failed"),
        F.coalesce(F.bool_or(unlike), F.lit(False)).alias("counts_differ"),
        (F.max(o("expected_digest")) if has else F.lit(None).cast("string")).alias("oracle_digest"),
    )
    walls = F.transform("runs", lambda r: r["wall"])
    each = each.withColumn("repetitions", F.size("runs").cast("long")).withColumn("median_wall", array_median(walls)).withColumn("mad_wall", array_mad(walls, F.col("median_wall")))
    each = each.withColumn("noise_ratio", S.noise_ratio(F.col("mad_wall"), F.col("median_wall")))
    base = each.select(F.col("result").alias("baseline"), F.col("runs").alias("base_runs"), F.col("noise_ratio").alias("base_noise"))
    ratio = lambda r: F.transform(F.filter("base_runs", lambda b: b["repetition"] == r["repetition"]), lambda b: S.speedup(b["wall"], r["wall"]))
    out = each.join(base, "baseline", "left").withColumn("_ratios", F.array_compact(F.flatten(F.transform("runs", ratio))))
    out = out.withColumn("median_speedup", array_median(F.col("_ratios"))).withColumn("speedup_mad", array_mad(F.col("_ratios"), F.col("median_speedup")))
    return out.withColumn("speedup_noise", S.noise_ratio(F.col("speedup_mad"), F.col("median_speedup"))).drop("_ratios")


def bench_summary(samples: DataFrame) -> DataFrame:
    more = samples.groupBy("result").agg(
        F.median("cpu_seconds").alias("median_cpu"),
        F.max("peak_rss_bytes").alias("max_rss"),
        F.min_by("item_count", "repetition").alias("items"),
        F.min_by("logical_bytes", "repetition").alias("bytes"),
        upper_median("allocated_bytes").alias("median_allocated"),
        upper_median("wire_bytes").alias("median_wire"),
    )
    own = measured(samples).select("result", "baseline", "repetitions", "median_wall", "mad_wall", "median_speedup")
    return own.join(more, "result").withColumn("throughput", S.throughput(F.col("median_allocated"), F.col("median_wall")))


def phase_medians(samples: DataFrame) -> DataFrame:
    """result, phase, median_seconds, n over the samples that have the phase; what the phases leave of the wall time is
    a phase `unaccounted` where it is over the limit."""
    total = F.aggregate(F.map_values("phases"), F.lit(0.0), lambda a, x: a + x)
    gap = F.col("wall_seconds") - total
    more = F.when(F.abs(gap) > UNACCOUNTED * F.col("wall_seconds"), F.create_map(F.lit("unaccounted"), F.greatest(gap, F.lit(0.0))))
    whole = F.when(more.isNotNull(), F.map_concat("phases", more)).otherwise(F.col("phases"))
    return samples.select("result", F.explode(whole).alias("phase", "seconds")).groupBy("result", "phase").agg(F.median("seconds").alias("median_seconds"), F.count("*").alias("n"))


def noise(samples: DataFrame) -> DataFrame:
    """result, noise_ratio, comparable: the row's own and its baseline's noise are both within the limit."""
    worst = F.greatest("noise_ratio", F.coalesce("base_noise", F.lit(0.0)))
    return measured(samples).select("result", "noise_ratio", (worst <= NOISE_LIMIT).alias("comparable"))


@dataclass(frozen=True)
class Report:
    """What a report says of itself; two reports are compared only where all but the build agree."""

    schema: str = "report.v1"
    profile: str = "release"
    environment: str = ""
    session: str = ""
    corpus_digest: str | None = None

    def unlike(self, other: Report) -> list[str]:
        return [name for name in ("schema", "environment", "session", "corpus_digest") if getattr(self, name) != getattr(other, name)]


def _status(ratio_noise: str = "speedup_noise") -> Column:
    """What becomes of a result (of measured()) that is held against its past (_past_*)."""
    stable = lambda p: (F.col(f"{p}repetitions") >= LEAST_REPETITIONS) & (F.col(f"{p}noise_ratio") <= NOISE_LIMIT) & (F.coalesce(f"{p}speedup_noise", F.lit(1.0)) <= NOISE_LIMIT)
    return (
        F.when(F.col("_past_result").isNull(), "skipped: not in history")
        .when(F.col("median_speedup").isNull() | F.col("_past_median_speedup").isNull(), "skipped: no baseline")
        .when(~F.col("baseline").eqNullSafe(F.col("_past_baseline")), "skipped: another baseline")
        .when(~(stable("") & stable("_past_")), "skipped: noisy")
        .when(F.col("median_speedup") < F.col("_past_median_speedup") * (1 - TOLERANCE), "regressed")
        .otherwise("ok")
    )


_COMPARED = ("result", "baseline", "repetitions", "noise_ratio", "median_speedup", "speedup_noise")


def _with_past(current: DataFrame, historical: DataFrame) -> DataFrame:
    past = historical.select(*[F.col(c).alias(f"_past_{c}") for c in _COMPARED])
    return current.join(past, F.col("result") == F.col("_past_result"), "left").withColumn("status", _status())


def gate_compare(current: DataFrame, historical: DataFrame) -> DataFrame:
    """result, ratio, status (ok, regressed, or why it is skipped) of two tables of measured()."""
    return _with_past(current, historical).select("result", (F.col("median_speedup") / F.col("_past_median_speedup")).alias("ratio"), "status")


def bench_gate(current: DataFrame, historical: DataFrame | None = None, strict: bool = False, report: Report = Report(), past_report: Report | None = None) -> DataFrame:
    """severity, result, message of everything the gate finds in measured(samples), alone and against the past. Unlike
    reports, or a past one that isn't right itself, are not compared; strict makes a failure of nothing compared."""
    spark = current.sparkSession
    whole, unlike = [], report.unlike(past_report) if past_report else []
    if report.profile != "release":
        whole.append(("fail", "", "not a release build"))
    if report.schema != Report.schema:
        whole.append(("fail", "", "unknown schema"))
    if historical is None:
        whole.append(("warn", "", "no history"))
    elif unlike:
        whole.append(("warn", "", f"reports differ in {', '.join(unlike)}"))
    elif past_report and (past_report.profile != "release" or _findings(historical, past_report).filter("severity = 'fail'").limit(1).count()):
        whole.append(("warn", "", "the past report fails its own checks"))
        unlike = ["past"]
    compared = historical is not None and not unlike
    joined = _with_past(current, historical) if compared else current.withColumn("status", F.lit(None).cast("string"))
    out = _findings(joined, report)
    if strict:
        done = joined.agg(F.count_if(F.col("status").isin("ok", "regressed")).alias("n")).filter("n = 0")
        out = out.unionByName(done.select(F.lit("fail").alias("severity"), F.lit("").alias("result"), F.lit("nothing was compared").alias("message")))
    return out.unionByName(spark.createDataFrame(whole, "severity string, result string, message string")) if whole else out


def _findings(rows: DataFrame, report: Report) -> DataFrame:
    wrong = F.col("oracle_failed") | (~F.col("oracle_digest").eqNullSafe(F.lit(report.corpus_digest)) if report.corpus_digest else F.lit(False))
    found = [
        (F.col("repetitions") < LEAST_REPETITIONS, "fail", F.lit("too few repetitions")),
        (F.col("items_differ"), "fail", F.lit("samples of unlike work")),
        (wrong, "fail", F.lit("the result is not the corpus")),
        (F.col("counts_differ"), "fail", F.lit("counts differ from the result's")),
        ((F.col("median_wall") > 0) & (F.col("noise_ratio") > NOISE_LIMIT), "warn", F.lit("noisy")),
    ]
    if "status" in rows.columns:
        found += [(F.col("status") == "regressed", "fail", F.col("status")), (F.startswith(F.col("status"), F.lit("skipped")), "warn", F.col("status"))]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(severity).alias("severity"), m.alias("message"))) for c, severity, m in found]))
    return rows.select("result", F.explode(listed).alias("f")).select("f.severity", "result", "f.message")


def bench_validate(samples: DataFrame) -> DataFrame:
    """result, message of samples that make no valid report: one aggregation of rules on single samples, and the rules
    of pairing with the baseline on the results' few rows."""
    has = lambda name: name in samples.columns
    finite = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < float("inf")), F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    named = F.coalesce((F.size("phases") > 0) & F.forall(F.map_entries("phases"), lambda e: ~blank(e["key"]) & (e["value"] >= 0) & (e["value"] < float("inf"))), F.lit(False))
    cold = F.col("cache_state") == "cold_evicted" if has("cache_state") else F.lit(False)
    evicted = cold == ~blank(F.col("cache_eviction_method")) if has("cache_state") else F.lit(True)
    each = samples.groupBy("result").agg(
        F.first("baseline", ignorenulls=True).alias("baseline"),
        F.bool_and(finite("wall_seconds") & (F.col("wall_seconds") > 0)).alias("timed"),
        F.bool_and(finite("cpu_seconds")).alias("cpu"),
        F.bool_and(named).alias("phased"),
        F.bool_and(F.coalesce(evicted, F.lit(False))).alias("evicted"),
        F.array_sort(F.collect_list(F.struct("repetition", F.col("method_order").alias("order")))).alias("runs"),
        (F.min("result_number") != F.max("result_number") if has("result_number") else F.lit(False)).alias("shared"),
    )
    base = each.select(F.col("result").alias("baseline"), F.col("runs").alias("base_runs"))
    rows = each.join(base, "baseline", "left")
    reps = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda r: r["repetition"])))
    side = lambda less: F.exists("runs", lambda r: F.exists("base_runs", lambda b: (b["repetition"] == r["repetition"]) & ((r["order"] < b["order"]) if less else (r["order"] > b["order"]))))
    paired, there = F.col("baseline").isNotNull(), F.col("base_runs").isNotNull()
    found = [
        (blank(F.col("result")), "a result has no name"),
        (F.col("shared"), "a name stands for two results"),
        (~F.col("timed"), "wall seconds must be above 0"),
        (~F.col("cpu"), "cpu seconds must be 0 or more"),
        (F.size(reps(F.col("runs"))) < F.size("runs"), "a repetition occurs twice"),
        (~F.col("phased"), "phases must have names and seconds"),
        (~F.col("evicted"), "a cold cache, and no other, has a method of eviction"),
        (paired & ~there, "the baseline is missing"),
        (there & (reps(F.col("runs")) != reps(F.col("base_runs"))), "repetitions differ from the baseline's"),
        (there & (F.size("runs") > 1) & ~(side(True) & side(False)), "the order never crosses over"),
    ]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in found]))
    return rows.select("result", F.explode(listed).alias("message"))


def report_validate(reports: DataFrame) -> DataFrame:
    """message of what is wrong with reports(schema, build, environment, session, corpus(id, digest), tools, results)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = [(blank(c), f"{c} is blank") for c in ("schema", "build", "environment", "session", "corpus.id")]
    found.append((~F.coalesce(F.col("corpus.digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "the corpus has no digest of 64 lower-case hexadecimal digits"))
    found += [(F.coalesce(F.size(c), F.lit(0)) < 1, f"no {c}") for c in ("tools", "results")]
    return reports.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in found]))).alias("message"))


def engine_summary(samples: DataFrame, budget_bytes: int) -> DataFrame:
    """One row of samples(item_count, scan_seconds, index_seconds, planner_seconds, queue_high_water, peak_rss_bytes)."""
    rate = S.throughput(F.col("item_count"), F.col("scan_seconds"))
    columns = ("scan_rate", "index_seconds", "planner_seconds")
    out = samples.withColumn("scan_rate", rate).agg(
        *[F.collect_list(F.col(c).cast("double")).alias(c) for c in columns], F.max("queue_high_water").alias("max_queue"), F.max("peak_rss_bytes").alias("max_rss"), F.count("*").alias("repetitions")
    )
    out = out.withColumns({f"median_{c}": array_median(F.col(c)) for c in columns}).withColumns({f"mad_{c}": array_mad(F.col(c), F.col(f"median_{c}")) for c in columns})
    return out.withColumn("budget_passed", F.col("max_rss") <= budget_bytes).drop(*columns)


def clone_summary(samples: DataFrame) -> DataFrame:
    """One row of samples(repetition, method_order, method, wall_seconds, disposition): cloned against buffered."""
    side = lambda m, p: samples.filter(F.col("method") == m).select("repetition", F.col("wall_seconds").alias(f"{p}_wall"), F.col("method_order").alias(f"{p}_order"), F.col("disposition").alias(f"{p}_what"))
    both = side("buffered", "b").join(side("clone", "c"), "repetition")
    return both.agg(
        F.median(F.col("b_wall") / F.col("c_wall")).alias("median_speedup"),
        (F.bool_or(F.col("b_order") < F.col("c_order")) & F.bool_or(F.col("b_order") > F.col("c_order"))).alias("crosses_over"),
        F.bool_and(F.col("c_what") == "cloned").alias("capability"),
    )


def remote_summary(samples: DataFrame) -> DataFrame:
    """result, medians of wall, wire and setup (null where it wasn't taken), max RSS, paired speedup and its MAD."""
    setup = F.median("setup_seconds") if "setup_seconds" in samples.columns else F.lit(None).cast("double")
    more = samples.groupBy("result").agg(F.median("wire_bytes").alias("median_wire"), setup.alias("median_setup"), F.max("peak_rss_bytes").alias("max_rss"))
    own = measured(samples).select("result", "median_wall", F.col("median_speedup").alias("speedup"), "speedup_mad")
    return own.join(more, "result")


def compression_probe(contents: DataFrame, sizes: list[int], codec: str = "zstd-3") -> DataFrame:
    """codec, sample_bytes, selected, raw_bytes, adaptive_bytes, ratio of contents(content) for each sample size: what would
    be compressed by the sample is counted at the sample's ratio."""
    cut = contents.select(F.explode(F.array(*[F.lit(n) for n in sizes])).alias("sample_bytes"), F.col("content").cast("binary").alias("content"))
    size = F.octet_length("content").cast("long")
    sampled = cut.select("sample_bytes", size.alias("raw"), F.substring("content", F.lit(1), F.col("sample_bytes")).alias("sample"))
    packed = sampled.withColumn("packed", S.compressed_size(F.col("sample"), codec)).withColumn("seen", F.octet_length("sample").cast("long"))
    chosen = S.should_compress(F.col("packed"), F.col("seen"))
    adaptive = F.when(chosen, F.floor(F.col("raw") * F.col("packed") / F.col("seen"))).otherwise(F.col("raw"))
    out = packed.groupBy("sample_bytes").agg(F.count_if(chosen).alias("selected"), F.sum("raw").alias("raw_bytes"), F.sum(adaptive).alias("adaptive_bytes"))
    return out.withColumns({"ratio": S.ratio(F.col("adaptive_bytes"), F.col("raw_bytes"), 1.0), "codec": F.lit(codec)})


def wire_accounting(df: DataFrame) -> DataFrame:
    """overhead of (wire_bytes, data_bytes): null where no data was counted."""
    return df.withColumn("overhead", F.when(F.col("data_bytes") > 0, F.col("wire_bytes") - F.col("data_bytes")))

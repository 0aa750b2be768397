"""Include and exclude rules in written order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.functions import paths as P
from grovekit.functions.globs import Rule
from grovekit.functions.rulesets import Matcher, RuleSet

#: Rules that stand in one expression; more of them run as automata, to the same decisions.
EXPRESSION_RULES = 24
#: Paths of one scope that a task matches, about.
SCOPE_ROWS = 200_000


def _match(rule: Rule, path: Column) -> Column:
    if not rule.scope:
        return path.rlike(rule.regex)
    inside = F.lit(f"{rule.scope}/")
    return F.startswith(path, inside) & F.substr(path, F.lit(len(rule.scope) + 2)).rlike(rule.regex)


def filter_decide(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """df(path, ..) with included, pattern, origin, via (the path that the rule matched; null: no rule did).

    Order: the command line's rules on the path, on its ancestors nearest first, then ignore files' rules likewise;
    within each the deepest scope and then the first rule written. Rules are a list in the program, so each becomes a
    literal pattern in one expression over the path's own array: no join and no exchange. More than EXPRESSION_RULES run
    as automata in Arrow batches (decide_by_automaton): the time of a path then hardly depends on their number."""
    if len(rules) > EXPRESSION_RULES:
        return decide_by_automaton(df, rules)
    if not rules:
        return df.withColumns({"included": F.lit(True), "pattern": F.lit(None).cast("string"), "origin": F.lit(None).cast("string"), "via": F.lit(None).cast("string")})

    def best(path: Column, distance: Column) -> Column:
        found = [
            F.when(
                _match(r, path),
                F.struct(
                    F.lit(r.tier).alias("tier"), distance.alias("distance"), F.lit(-len(r.scope)).alias("scope"), F.lit(r.ord).alias("ord"),
                    F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.lit(r.origin).alias("origin"), path.alias("via"),
                ),
            )
            for r in rules
        ]
        return F.least(*found) if len(found) > 1 else found[0]

    decided = F.array_min(F.transform(P.path_and_ancestors(F.col("path")), best))
    return df.withColumn("_d", decided).withColumns(
        {"included": F.coalesce(F.col("_d.action") == "include", F.lit(True)), "pattern": F.col("_d.pattern"), "origin": F.col("_d.origin"), "via": F.col("_d.via")}
    ).drop("_d")


def decide_by_automaton(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """filter_decide() by one automaton for each tier and scope, compiled once a task. Paths that are null are included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = RuleSet(rules).decide
        for batch in batches:
            found = [decide(x) if x is not None else None for x in batch.column("path").to_pylist()]
            columns = {
                "included": pa.array([not x or x[0].action == "include" for x in found], pa.bool_()),
                "pattern": pa.array([x and x[0].pattern for x in found], pa.string()),
                "origin": pa.array([x and x[0].origin for x in found], pa.string()),
                "via": pa.array([x and x[1] for x in found], pa.string()),
            }
            kept = [c for c in batch.schema.names if c not in columns]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns.values()], [*kept, *columns])

    kinds = {"included": T.BooleanType(), "pattern": T.StringType(), "origin": T.StringType(), "via": T.StringType()}
    schema = T.StructType([f for f in df.schema.fields if f.name not in kinds] + [T.StructField(c, t) for c, t in kinds.items()])
    return df.mapInArrow(run, schema)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one scope after another, its rules (ord, action, pattern) before its paths -> the action that holds for
    each path, with the distance of the directory above it that matched."""
    scope, rules, matcher, known = None, [], None, {}

    def above(path: str) -> tuple[str, int] | None:
        """(action, distance) by the path itself or the nearest directory above it that is inside the scope."""
        found = matcher.first(path[len(scope) + 1 :] if scope else path)
        if found is not None:
            return rules[found][1], 0
        parent = path.rpartition("/")[0]
        if len(parent) <= len(scope):
            return None
        if parent not in known:
            if len(known) >= 1 << 16:
                known.clear()
            known[parent] = above(parent)
        return known[parent] and (known[parent][0], known[parent][1] + 1)

    for batch in batches:
        out: list[tuple] = []
        for own, order, action, pattern, path in zip(*[batch.column(c).to_pylist() for c in ("scope", "ord", "action", "pattern", "path")]):
            if own != scope:
                scope, rules, matcher, known = own, [], None, {}
            if path is None:
                rules.append((order, action, pattern))
                continue
            if matcher is None:
                rules.sort()
                matcher = Matcher([p for _, _, p in rules])
            if path != scope and (found := above(path)):
                out.append((path, *found, -len(scope)))
        if out:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["path", "action", "dist", "depth"])


def ignore_scope_join(df: DataFrame, rules: DataFrame, scope_rows: int = SCOPE_ROWS) -> DataFrame:
    """df(path, ..) with included by a table of ignore rules (scope, ord, action, pattern), as many as there are: the
    nearest enclosing directory with a matching rule decides, on the path relative to it; ancestors of the path count
    after the path itself.

    Rules and paths of a scope meet in one sorted partition, in which the scope's rules come first and are compiled once.
    Scopes of more than scope_rows paths, such as the root, are dealt over several partitions, with their rules in each."""
    # (path, directory above it) once a level; those without rules go before anything is matched
    above = df.select("path").distinct().select("path", F.explode(F.concat(P.path_ancestors(F.col("path")), F.array(F.lit("")))).alias("scope"))
    held = rules.select("scope", "ord", "action", "pattern")
    ruled = above.join(held.select("scope").distinct(), "scope", "left_semi")
    # at most one row for so many paths
    large = F.broadcast(ruled.groupBy("scope").count().filter(F.col("count") > scope_rows).select("scope", F.ceil(F.col("count") / scope_rows).cast("long").alias("parts")))
    one = F.lit(1).cast("long")
    paths = ruled.join(large, "scope", "left").select("scope", F.pmod(F.xxhash64("path"), F.coalesce("parts", one)).alias("part"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("pattern"), "path")
    dealt = held.join(large, "scope", "left").select("scope", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1)).alias("part"), "ord", "action", "pattern", F.lit(None).cast("string").alias("path"))
    rows = dealt.unionByName(paths).repartition("scope", "part").sortWithinPartitions("scope", "part", F.col("path").asc_nulls_first())
    matched = rows.mapInArrow(_matched, "path string, action string, dist int, depth int")
    best = matched.groupBy("path").agg(F.min_by("action", F.struct("dist", "depth")).alias("_action"))
    return df.join(best, "path", "left").withColumn("included", F.coalesce(F.col("_action") == "include", F.lit(True))).drop("_action")


def descend_set(directories: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Directories that a scan must enter: included ones, and those below which an include rule could match, by what its
    automaton can still take after the directory's path. A `*` takes slashes too, so its pattern may match further down
    than it has components."""
    decided = filter_decide(directories, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descend = RuleSet(rules).descend
        for batch in batches:
            found = [path is not None and descend(path) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], [*batch.schema.names, "descend"])

    return decided.mapInArrow(run, T.StructType([*decided.schema.fields, T.StructField("descend", T.BooleanType())]))


def filter_explain(decided: DataFrame) -> DataFrame:
    """Excluded paths with the rule, its origin and the ancestor that it matched, if it was one."""
    via = F.when(F.col("via") != F.col("path"), F.concat(F.lit(" (through "), F.col("via"), F.lit(")"))).otherwise("")
    return decided.filter("not included").select("path", F.concat(F.lit("excluded by "), "pattern", F.lit(" at "), "origin", via).alias("reason"))


def filter_both_sides(src: DataFrame, dst: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Excluded entries of the destination are out of sight, so never deleted."""
    drop = ("included", "pattern", "origin", "via")
    return tuple(filter_decide(side, rules).filter("included").drop(*drop) for side in (src, dst))


def flat_exclude(df: DataFrame, globs: Sequence[str]) -> DataFrame:
    """Without the paths that, or an ancestor of which, match any of the globs."""
    rules = [Rule(0, i, "exclude", g) for i, g in enumerate(globs)]
    return filter_decide(df, rules).filter("included").drop("included", "pattern", "origin", "via")

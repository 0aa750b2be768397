"""License scans by MinHash bands over overlapping text windows. DataFrame functions only.

Templates of m five-word shingles belong to the class of the next power of two s. A class has windows of 2s shingles
that begin every s shingles (s = 1: every shingle is a window), so a template that stands in a text lies in a window
whole. A band is the least of the window's shingle hashes, each hashed again with the band's number; each band is looked
up alone, and there are so many that a window holding the least allowed part of a template shares one with it but for
MISS of cases. What is found is then checked by exact containment of the template's shingles."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm.common import documents
from grovekit.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-4
TEMPLATE_ROWS = 100_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 4


def shingled(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS), "")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template_id, shingles (distinct, as text), hashes, m, s."""
    words = spark.createDataFrame(list(templates.items()), "template_id string, text string").withColumn("words", shingled(F.col("text")))
    positions = F.sequence(F.lit(1), F.size("words") - SHINGLE + 1)
    text = F.array_distinct(F.transform(positions, lambda i: F.array_join(F.slice("words", i, SHINGLE), " ")))
    hashes = F.array_distinct(F.transform(positions, lambda i: F.xxhash64(*[F.element_at("words", i + j) for j in range(SHINGLE)])))
    return words.filter(F.size("words") >= SHINGLE).select("template_id", text.alias("shingles"), hashes.alias("hashes"), F.size(text).alias("m"))


def class_of(m: int) -> int:
    """The class of a template of m shingles: 1, or a power of two of BLOCK at least."""
    return 1 if m == 1 else max(BLOCK, 1 << (m - 1).bit_length())


def bands_for(m: int, s: int) -> int:
    """Bands that a window needs so as to miss the template with a chance of MISS at most."""
    if s == 1:
        return 1
    held = math.ceil(CONTAINED * m)
    return math.ceil(math.log(MISS) / math.log(1 - held / (2 * s + m - held)))


def band_values(hashes: Column, bands: int) -> Column:
    """Array of struct(band, value, source): for each band the least of the hashes under that band's own hashing, and the
    hash that it comes from. Hashing again orders the hashes anew for every band, as if by chance, so that a window of few
    shingles shares a band with a template as often as bands_for() reckons."""
    numbers = F.array(*[F.lit(k) for k in range(bands)])
    return F.transform(numbers, lambda k: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, k).alias("value"), h.alias("source"), k.alias("band")))))


def scan_licenses(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """A row per document and template found: doc_id, template_id, containment (the most of any window, as a share),
    n_windows.

    Null and empty texts and those of fewer words than a shingle have no row, and an empty table none. Repeated rows
    count their windows together, as do texts that share an id; a null id is an id. Very long texts are scanned whole;
    other columns, whatever their names, play no part. Templates of fewer words than a shingle can't be looked up and are
    refused. Templates are a list in the program; beyond TEMPLATE_ROWS bands or shingles their tables are not broadcast."""
    short = [k for k, v in templates.items() if len(re.sub(_SEPARATORS, " ", v.lower()).split()) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    spark = docs.sparkSession
    table = [r.asDict() for r in template_table(spark, templates).collect()]
    classes: dict[int, list[dict]] = {}
    for t in table:
        classes.setdefault(class_of(t["m"]), []).append(t)
    if not classes:
        return spark.createDataFrame([], "doc_id long, template_id string, containment double, n_windows long")
    bands = {s: max(bands_for(t["m"], s) for t in ts) for s, ts in classes.items()}
    held = spark.createDataFrame([(s, t["template_id"], t["hashes"]) for s, ts in classes.items() for t in ts], "s int, template_id string, hashes array<long>")
    found = held.withColumn("v", F.explode(band_values(F.col("hashes"), max(bands.values())))).select("s", "v.band", "v.value", "template_id", "v.source").collect()
    rows = [tuple(r)[:4] for r in found if r["band"] < bands[r["s"]]]
    # A window that has none of the hashes that the templates' bands come from can't share a band with a template, so its
    # bands needn't be worked out.
    sources = F.array(*[F.lit(h) for h in sorted({r["source"] for r in found if r["band"] < bands[r["s"]]})])
    words = shingled(F.col("text"))
    n = F.size("_words") - SHINGLE + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.element_at("_words", i + j) for j in range(SHINGLE)]))
    most = 2 * max(classes)
    at = F.col("block") * BLOCK
    # Tests of a text stand inside the generator: a filter would be moved below and have the words cut again.
    numbers = F.when(F.arrays_overlap("_hashes", sources), F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = (
        docs.select("doc_id", words.alias("_words"))
        .withColumn("_hashes", hashes)
        .select("doc_id", "_words", "_hashes", F.explode(numbers).alias("block"))
        .select("doc_id", "block", F.slice("_hashes", at + 1, most).alias("spread"), F.slice("_words", at + 1, most + BLOCK + SHINGLE - 1).alias("context"))
        .filter(F.arrays_overlap("spread", sources))
    )

    def values(s: int) -> Column:
        """The bands of the windows of class s that begin in a block."""
        numbers = F.array(*[F.lit(k) for k in range(bands[s])])

        def window(skip: int) -> Column:
            inside = F.slice("spread", skip + 1, 1 if s == 1 else 2 * s)
            return F.transform(
                numbers,
                lambda k: F.struct(F.lit(s).alias("s"), (at + skip).alias("start"), k.alias("band"), F.array_min(F.transform(inside, lambda h: F.xxhash64(h, k))).alias("value")),
            )

        if s == 1:
            return F.concat(*[window(j) for j in range(BLOCK)])
        return F.when(F.col("block") % (s // BLOCK) == 0, window(0)).otherwise(F.array())

    hits = blocks.select("doc_id", "block", "context", F.explode(F.concat(*[values(s) for s in sorted(classes)])).alias("f"))
    known = spark.createDataFrame(rows, "s int, band int, value long, template_id string")
    exact = spark.createDataFrame([(t["template_id"], t["shingles"]) for t in table], "template_id string, shingles array<string>")
    small = F.broadcast if max(len(rows), sum(t["m"] for t in table)) <= TEMPLATE_ROWS else lambda df: df
    pairs = (
        hits.select("doc_id", "block", "context", "f.*")
        .join(small(known), ["s", "band", "value"])
        .select("doc_id", "s", "start", "template_id", (F.col("start") - F.col("block") * BLOCK).alias("skip"), "context")
        .distinct()
        .join(small(exact), "template_id")
    )
    size = F.when(F.col("s") == 1, 1).otherwise(2 * F.col("s"))
    count = F.least(size, F.size("context") - F.col("skip") - SHINGLE + 1)
    window = F.transform(F.sequence(F.col("skip") + 1, F.col("skip") + count), lambda i: F.array_join(F.slice("context", i, SHINGLE), " "))
    held = F.size(F.array_intersect("shingles", window)) / F.size("shingles")
    return (
        pairs.withColumn("held", held)
        .filter(F.col("held") >= CONTAINED)
        .groupBy("doc_id", "template_id")
        .agg(F.max("held").alias("containment"), F.count("*").alias("n_windows"))
    )


def op2_license_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).select("doc_id", "text"), TEMPLATES)


_LISTED = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
OP2_SQL = rf"""
WITH t0(template_id, text) AS (VALUES {_LISTED}),
t1 AS (SELECT template_id, list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t0),
t2 AS (SELECT DISTINCT template_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT template_id, w, unnest(range(1, len(w) - 3)) AS i FROM t1)),
t3 AS (SELECT template_id, count(*) AS m FROM t2 GROUP BY template_id),
t4 AS (SELECT template_id, m, CASE WHEN m = 1 THEN 1 ELSE greatest(4, CAST(pow(2, ceil(log2(m))) AS BIGINT)) END AS s FROM t3),
d1 AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
d2 AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d1)),
x AS (SELECT d2.doc_id, d2.p, d2.k, t4.template_id, t4.m, t4.s FROM d2 JOIN t2 USING (k) JOIN t4 ON t4.template_id = t2.template_id),
y AS (SELECT doc_id, template_id, m, k, p // s AS b FROM x
      UNION ALL SELECT doc_id, template_id, m, k, p // s - 1 FROM x WHERE s > 1 AND p // s >= 1),
z AS (SELECT doc_id, template_id, b, count(DISTINCT k) / m AS held FROM y GROUP BY doc_id, template_id, b, m)
SELECT doc_id, template_id, max(held) AS containment, count(*) AS n_windows FROM z WHERE held >= 0.8 GROUP BY doc_id, template_id
"""

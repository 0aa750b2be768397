"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

The training texts are read and cut into words once. The index holds a posting (term, document row, position) for every
place of every term that occurs in a test phrase, in segments: each task writes its own, in the order of terms, rows and
positions. A search takes a phrase's terms from the rarest on, by their counts over all postings. The rarest one's list
gives the places where the phrase may begin; the second one's list, moved by its offset, leaves few of them, and the
lists of all others must then agree too. With a slop, a term may stand so many words from its place (a proximity match);
those whose terms all stand in place are exact."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from grovekit.llm.common import documents, staged

WINDOW = 10
#: Words by which a term of a proximity match may be out of place.
SLOP = 2
#: Tables of terms or phrases up to so many rows are broadcast (their rows are short); larger ones are exchanged.
BROADCAST_ROWS = 200_000
#: The term, and its number, of the entry that each document has in the index. No word holds a separator.
_HEAD, HEADS = " ", -1
# separators once A-Z count as letters; the words below are lower-cased afterwards
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words of a text with their capitals; null has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() on ASCII words is the same and quicker."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def phrases(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """items(item_id, text) -> item_id, phrase (words), key: every run of `size` words, or the whole of a shorter item."""
    words = F.transform(raw_words(F.col("text")), lowered)
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))
    cut = F.slice(F.col("words"), F.col("at") + 1, F.least(F.lit(size), n))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words"))
        .filter(n > 0)
        .select("item_id", "words", F.explode(starts).alias("at"))
        .select("item_id", cut.alias("phrase"))
        .withColumn("key", F.concat_ws(" ", "phrase"))
        .distinct()
    )


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def numbered_phrases(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The items' phrases (item_id, key) and the distinct ones (pid, key, phrase)."""
    found = staged(phrases(items, size), "test-phrases")
    distinct = found.groupBy("key").agg(F.first("phrase").alias("phrase"))
    return found.select("item_id", "key"), staged(distinct.withColumn("pid", F.monotonically_increasing_id()), "test-distinct")


def terms_of(distinct: DataFrame) -> DataFrame:
    """term, tid of every term of a phrase."""
    terms = distinct.select(F.explode("phrase").alias("term")).distinct()
    return staged(terms.withColumn("tid", F.monotonically_increasing_id()), "test-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings of terms(term, tid) over docs(doc_id, text): tid, row (a number of the document's row), pos.

    Each row of docs also has one entry with the tid of HEADS: its number of words as pos, its doc_id and _h (of its text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = terms.select("term", "tid").unionByName(docs.sparkSession.createDataFrame([(_HEAD, HEADS)], "term string, tid long"))
    each = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("row"), F.concat(F.array(F.lit(_HEAD)), raw_words(text)).alias("_words"))
    each = each.select("doc_id", "_h", "row", (F.size("_words") - 1).alias("_n"), F.posexplode("_words").alias("_p", "_w"))
    head = F.col("tid") == HEADS
    postings = each.join(_small(known), lowered(F.col("_w")) == F.col("term")).select(
        "tid",
        "row",
        F.when(head, F.col("_n")).otherwise(F.col("_p") - 1).alias("pos"),
        F.when(head, F.col("doc_id")).alias("doc_id"),
        F.when(head, F.col("_h")).alias("_h"),
    )
    return staged(postings.sortWithinPartitions("tid", "row", "pos"), "positional-index")


def rarest_first(index: DataFrame, distinct: DataFrame, terms: DataFrame) -> DataFrame:
    """pid, m (terms), by (their counts, places and numbers, the rarest first) of the phrases all of whose terms occur."""
    counts = index.filter(F.col("tid") != HEADS).groupBy("tid").agg(F.count("*").alias("n"))
    each = distinct.select("pid", F.size("phrase").alias("m"), F.posexplode("phrase").alias("at", "term")).join(terms, "term").join(counts, "tid")
    ranked = each.groupBy("pid", "m").agg(F.sort_array(F.collect_list(F.struct("n", "at", "tid"))).alias("by"))
    return staged(ranked.filter(F.size("by") == F.col("m")), "test-ranked")


def _agreeing(wanted: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """wanted(pid, row, start, at, tid) whose term stands within `slop` words of start + at, and by how many."""
    width = 2 * slop + 1
    place = F.col("start") + F.col("at")
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    near = wanted.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(place - slop), bucket(place + slop))))) if slop else wanted.withColumn("_b", place.cast("long"))
    there = lists.select("row", "tid", F.col("pos").alias("_p"), (bucket(F.col("pos")) if slop else F.col("pos").cast("long")).alias("_b"))
    off = F.abs(F.col("_p") - place)
    found = near.join(there, ["row", "tid", "_b"]).filter(off <= slop)
    return found.groupBy("pid", "row", "start", "at").agg(F.min(off).alias("off"))


def phrase_matches(index: DataFrame, ranked: DataFrame, slop: int = 0) -> DataFrame:
    """Every place of every phrase: pid, row, start, length, off. The rarest term stands in place (the earliest of equally
    rare ones); off is by how many words the others are out of it, together: 0 for an exact match."""
    first = ranked.select("pid", "m", F.col("by")[0]["tid"].alias("tid"), F.col("by")[0]["at"].alias("at"))
    begun = index.join(_small(first), "tid").select("pid", "m", "row", (F.col("pos") - F.col("at")).alias("start"))
    second = F.get("by", F.lit(1))
    next_ = staged(ranked.filter("m > 1").select("pid", second["tid"].alias("tid"), second["at"].alias("at")), "test-second")
    lists = index.join(_small(next_.select("tid").distinct()), "tid", "left_semi")
    two = _agreeing(begun.join(_small(next_), "pid"), lists, slop).select("pid", "row", "start", "off")
    two = staged(two, "test-candidates")
    # the lists of the other terms, in the documents that are left
    rest = ranked.filter("m > 2").select("pid", F.explode(F.slice("by", 3, F.greatest(F.size("by") - 2, F.lit(1)))).alias("x")).select("pid", "x.at", "x.tid")
    held = index.filter(F.col("tid") != HEADS).join(_small(two.select("row").distinct()), "row", "left_semi")
    others = _agreeing(two.select("pid", "row", "start").join(_small(rest), "pid"), held, slop)
    others = others.groupBy("pid", "row", "start").agg(F.count("*").alias("_n"), F.sum("off").alias("_off"))
    sized = two.join(_small(ranked.select("pid", "m")), "pid")
    whole = sized.filter("m > 2").join(others, ["pid", "row", "start"]).filter("_n = m - 2").withColumn("off", F.col("off") + F.col("_off"))
    parts = (begun.filter("m = 1").withColumn("off", F.lit(0)), sized.filter("m = 2"), whole)
    a, b, c = (p.select("pid", "row", "start", F.col("m").alias("length"), F.col("off").cast("long").alias("off")) for p in parts)
    return a.unionByName(b).unionByName(c)


def _found(docs: DataFrame, items: DataFrame, size: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """The index of docs, and matches with their items: row, start, length, off, item_id."""
    found, distinct = numbered_phrases(items, size)
    terms = terms_of(distinct)
    index = build_index(docs, terms)
    matches = staged(phrase_matches(index, rarest_first(index, distinct, terms), slop), "test-matches")
    names = found.join(distinct.select("key", "pid"), "key").select("pid", "item_id")
    return index, matches.join(_small(names), "pid").drop("pid")


def search(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Every place in docs of every phrase of items: doc_id, item_id, start, length, off (0: exact). Nulls and repeated
    rows as in contamination()."""
    index, found = _found(docs, items, size, slop)
    heads = index.filter(F.col("tid") == HEADS).select("row", "doc_id")
    return found.join(heads, "row").select("doc_id", "item_id", "start", "length", "off")


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id, _h, n_words); and of those with a match: row, n_hit, items, near."""
    index, found = _found(docs, items, size, slop)
    found = staged(found, "test-found")
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max(end).over(W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hit = (
        found.filter("off = 0")
        .select("row", "start", "length")
        .distinct()
        .withColumn("new", F.greatest(F.lit(0), end - F.greatest(before, F.col("start"))))
        .groupBy("row")
        .agg(F.sum("new").cast("long").alias("n_hit"))
    )
    each = found.filter("item_id is not null").groupBy("row", "item_id").agg(F.min("off").alias("off"))
    named = each.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("off") == 0, F.col("item_id")))).alias("items"), F.count("*").alias("near"))
    rows = index.filter(F.col("tid") == HEADS).select("row", "doc_id", "_h", F.col("pos").cast("long").alias("n_words"))
    return rows, staged(hit.join(named, "row", "full_outer"), "test-hits")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (items with an
    exact or a proximity match).

    Null texts have no words; null item texts no phrases; an item without an id hits words but isn't counted. Every row
    of docs, repeated or not, and whatever its id, is a document. Very long texts are read whole. Empty tables give an
    empty result or no hits. Other columns play no part."""
    rows, known = hits(docs, items, size, slop)
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(known, "row", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near_items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs in which no phrase of an item occurs, with their columns."""
    rows, known = hits(docs, items, size, 0)
    bad = staged(rows.join(known.filter("n_hit > 0"), "row").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).distinct(), "test-bad")
    h = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (h == bad["_g"]), "left_anti")


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(documents(spark, sf_dir), items)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
pt AS (SELECT DISTINCT k, n, pl, string_split(k, ' ')[pl] AS term FROM (SELECT k, n, unnest(range(1, n + 1)) AS pl FROM bw)),
dp AS (SELECT doc_id, i, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT term FROM pt)),
ct AS (SELECT term, count(*) AS c FROM dp GROUP BY term),
rare AS (SELECT k, n, arg_min(pl, (c, pl)) AS pl, arg_min(term, (c, pl)) AS term FROM pt JOIN ct USING (term) GROUP BY k, n HAVING count(*) = n),
begun AS (SELECT k, n, doc_id, i - pl AS start FROM rare JOIN dp USING (term)),
near AS (SELECT k, doc_id FROM begun JOIN pt USING (k, n) JOIN dp USING (doc_id, term) WHERE dp.i BETWEEN start + pl - 2 AND start + pl + 2
         GROUP BY k, n, doc_id, start HAVING count(DISTINCT pl) = n),
x AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN bw USING (k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""

"""Clashing names, hostile values and laws that the other tests leave out."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_draws_follow_the_hypergeometric_law():
    from grovekit.llm.sharding import communication_matrix, draw

    rng = np.random.default_rng(1)
    for good, bad, n in ((3000, 7000, 500), (700_000, 300_000, 600_000), (50, 99_950, 40_000)):
        ours, theirs = np.array([draw(rng, good, bad, n, most=1) for _ in range(8000)]), rng.hypergeometric(good, bad, n, size=8000)
        edges = np.unique(np.quantile(theirs, np.linspace(0, 1, 16)[1:-1]))
        x, y = (np.bincount(np.searchsorted(edges, v), minlength=len(edges) + 1) for v in (ours, theirs))
        assert ((x - y) ** 2 / np.maximum(x + y, 1)).sum() < 45  # chi-square, at most 14 degrees of freedom
    total = 10**13
    far = np.array([draw(rng, total // 3, total - total // 3, 10**11) for _ in range(2000)], float)
    assert abs(far.mean() / (10**11 / 3) - 1) < 1e-5 and 0.93 < far.std() / np.sqrt(10**11 * 2 / 9 * 0.99) < 1.07
    m = communication_matrix([5 * 10**9, 3 * 10**9 + 7], [2 * 10**8] * 40 + [7], 1)
    assert m.sum(axis=1).tolist() == [5 * 10**9, 3 * 10**9 + 7] and m.sum(axis=0).tolist() == [2 * 10**8] * 40 + [7]


def test_shuffle_is_uniform(spark):
    from grovekit.llm.sharding import shuffle_into_shards

    table = spark.range(0, 12, 1, 3).withColumnRenamed("id", "doc_id")
    seen = np.zeros((12, 3))
    for seed in range(60):
        for r in shuffle_into_shards(table, 3, seed=seed * 31).collect():
            seen[r["doc_id"], r["shard"]] += 1
    assert (seen.sum(axis=1) == 60).all() and ((seen - 20) ** 2 / 20).sum() < 60  # 24 degrees of freedom


def test_sharding_query(spark, tmp_path):
    import zlib

    from grovekit.llm.sharding import op6_hypergeometric_sharding

    rows = [(i, None if i == 3 else "é" * i) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_hypergeometric_sharding(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows
    }
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == [*range(40)] and all(sorted(v) == [*range(len(v))] and len(v) in (2, 3) for v in slots.values())


NAMES = "row rid part rank upto key block slot shard h _h _key _words content_digest tokenizer_digest n_tokens n_bytes over_limit score predicted cid n component_id _d _g pid tid start item_id"


def test_clashing_names(spark, tmp_path):
    """Columns named as those inside the operators are kept, or replaced where the result has that name."""
    import public_tokenizers

    from grovekit.llm.decontamination import contamination, without_contaminated
    from grovekit.llm.jaccard_join import link_components, one_of_each
    from grovekit.llm.licenses import TEMPLATES, scan_licenses
    from grovekit.llm.packing import pack_documents
    from grovekit.llm.sharding import shuffle_into_shards
    from grovekit.llm.token_counts import count_tokens
    from grovekit.llm.topk import top_k
    from grovekit.llm.toxicity import learn, score_documents
    from grovekit.llm.warc import plan_revisits

    names, texts = NAMES.split(), ["Released under the MIT License.", "one two three four five six", "one two three four five six", None, ""]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    want = {i: {n: f"{n}{i}" for n in names} for i in range(5)}

    def kept(df, replaced=()):
        for r in df.collect():
            assert {n: r[n] for n in names if n not in replaced} == {n: v for n, v in want[r["doc_id"]].items() if n not in replaced}
        return df.count()

    assert kept(shuffle_into_shards(docs, 2), ("shard", "slot")) == 5
    assert kept(count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"), ("n_bytes", "n_tokens", "over_limit")) == 5
    assert kept(one_of_each(docs)) == 4
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert kept(without_contaminated(docs, items)) == 3
    labels = spark.createDataFrame([(0, 1, "x")], "doc_id long, toxic int, score string")
    assert kept(score_documents(docs, learn(docs, labels)), ("score", "predicted")) == 5
    assert contamination(docs, items).filter("contaminated").count() == 2
    assert scan_licenses(docs, TEMPLATES).count() == 1 and link_components(docs).count() == 5
    assert pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id").distinct().count() == 5
    vectors = spark.createDataFrame([(i, [float(i)], *[n] * 3) for i, n in enumerate("abc")], "vec_id long, embedding array<double>, row string, block string, v string")
    assert top_k(vectors, F.lit(True)).count() == 6
    pages = spark.createDataFrame([(1, "u", "x" * 2000, "c"), (2, "u", "x" * 2000, "c")], "page_id long, url string, html string, payload string")
    assert plan_revisits(pages).filter("refers_to = 2").count() == 1


def test_cache_rows_that_stand_twice(spark, tmp_path):
    import public_tokenizers

    from grovekit.llm.token_counts import count_tokens, read_cache

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    first = sorted(map(tuple, count_tokens(docs, path, cache).collect()))
    read_cache(spark, cache).write.parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").write.mode("append").parquet(cache)
    assert sorted(map(tuple, count_tokens(docs, path, cache).collect())) == first and len(first) == 3


def test_scores_beyond_64_bits(spark):
    from grovekit.llm.topk import top_k

    rows = [(0, [1e18, 1e18]), (1, [1e18, 1e18]), (2, [-1e18, -1e18]), (3, [1.0, 2.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    most = 2**63 - 1
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, most), (2, 3, most), (3, 2, -most)]


def test_long_words_are_told_apart():
    """Two words on which any polynomial of an odd base modulo 2^64 agrees."""
    import pyarrow as pa

    from grovekit.llm.hashing import blocks, word_hashes

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    for _, data, edges in blocks(pa.array([f"{a} {b} {a.upper()} short"])):
        h, _ = word_hashes(data, edges)
        assert h[0] != h[1] and h[0] == h[2]


def test_texts_of_one_id(spark):
    """An id with two texts learns from both, so a word that half of the labels' texts hold tells nothing."""
    from grovekit.llm.toxicity import learn

    rows = [(i * 3, f"zork w{i}") for i in range(60)] + [(i * 3, f"calm v{i}") for i in range(60)]
    labels = [(i * 3, int(i % 2)) for i in range(60)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexicon == {} and model.score("zork") == model.score("calm")


@pytest.mark.parametrize("form", ["hex", "base32", "folded"])
def test_digest_forms(form):
    import base64

    from grovekit.llm.warc import record_bytes, salvage

    body = b"some payload"
    record = record_bytes(1, "http://x/", body, len(body), hashlib.sha1(body).hexdigest(), None)
    block = record.partition(b"\r\n\r\n")[2][:-4]
    digest = hashlib.sha1(block)
    if form == "base32":
        record = record.replace(digest.hexdigest().encode(), base64.b32encode(digest.digest()))
    if form == "folded":
        record = record.replace(b"WARC-Target-URI: ", b"WARC-Target-URI:\r\n\t")
    whole = [x for x in salvage(record + record) if x[3]]
    assert len(whole) == 2 and whole[0][3]["warc-target-uri"] == "http://x/"
    bad = record.replace(b"payload\r\n", b"pAyload\r\n")
    assert bad != record and [x[2] for x in salvage(bad + record)] == ["block digest", None]


def test_queries_agree_with_their_sql(spark):
    import os

    import duckdb

    from grovekit.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, folder)
        theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert collections.Counter(map(tuple, got.collect())) == collections.Counter(theirs), name
    for name in QUERIES.keys() - ORACLE_SQL.keys() - {"op13_embedding_whitening"}:
        assert QUERIES[name](spark, folder).select("doc_id").distinct().count() == con.execute("SELECT count(*) FROM documents").fetchone()[0], name


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage by itself in plain Python: words of insult, all pairs of shingle sets, all windows, the tokenizer."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    plain = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    insults, rows, labels = ("zork", "blim", "quag"), [], []
    for i in range(400):
        w = plain(60)
        if i % 5 == 0:
            for k in rng.integers(0, 60, 4):
                w[k] = insults[rng.integers(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    item = [f"bench{k}" for k in range(14)]
    for i in range(401, 480):  # copies, near copies, passages of the benchmark
        w = rows[int(rng.integers(0, 80)) * 5 + 1][1].split()
        for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[k] = f"new{i}x{k}"
        if i % 4 == 0:
            at = int(rng.integers(0, 5))
            w[20:20] = item[at : at + int(rng.integers(8, 13))]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " ".join(plain(9000)))]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: (t or "").split() for i, t in rows}
    left = {i: w for i, w in left.items() if not set(w) & set(insults)}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for i, w in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = {i: w for i, w in left.items() if find(i) == i}
    windows = {tuple(item[k : k + 10]) for k in range(5)}
    left = {i: w for i, w in left.items() if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    model, texts = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), dict(rows)
    tokens = {i: [*model.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in left}

    got, pieces, sequences = corpus_pipeline.run(spark, str(tmp_path)).collect(), collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = np.array(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(tokens[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(left) and 300 < len(left) < 400
    for i, found in [*pieces.items(), *sequences.items()]:
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
    assert all(sum(n for _, n in p) == len(tokens[i]) for i, p in pieces.items()) and all(sum(n for _, n in p) <= 4096 for p in sequences.values())

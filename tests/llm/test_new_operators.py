"""Content sort, prefix trie and whitening against brute force: nulls, empty and long texts, ties, hot groups, clashes."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_content_sort_against_brute_force(spark):
    from grovekit.llm.content_sort import mark_copies, without_copies

    rng = np.random.default_rng(3)
    head, long = "h" * 200, " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [None, "", " ", "\n\t", "a b", "a \n b", "a b ", "é b", head + "1", head + "2", long, long + " x", *[f"t{i} \x0b {i}" for i in range(30)]]
    hot = "the same \r\n text"
    rows = [(int(i), hot if k % 3 == 0 else texts[rng.integers(len(texts))], f"r{k}") for k, i in enumerate(rng.permutation(1200))]
    rows += [(5, hot, "again"), (5, hot, "again"), (None, hot, "no id"), (None, "alone", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept string").repartition(7)
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[body(t)].append(i)
    least = {b: min((i for i in ids if i is not None), default=None) for b, ids in groups.items()}
    want = collections.Counter((i, least[body(t)], len(groups[body(t)]), hashlib.sha256(body(t).encode()).hexdigest()) for i, t, _ in rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "40"):  # 40 ranges cut the hot text many times
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = mark_copies(docs).collect()
            assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
            kept = [r for r in got if r["kept"]]
            assert collections.Counter((r["doc_id"], r["text_sha256"]) for r in kept) == collections.Counter(
                (least[b], hashlib.sha256(b.encode()).hexdigest()) for b in groups
            )
            left = without_copies(docs)
            assert left.columns == docs.columns and left.count() == len(groups)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert mark_copies(docs.filter("false")).count() == 0
    named = spark.createDataFrame([("b", "x", 1), ("a", "x", 2)], "doc_id string, text string, run int")
    assert {(r["doc_id"], r["run"], r["keep_id"], r["kept"]) for r in mark_copies(named).collect()} == {("a", 2, "a", True), ("b", 1, "a", False)}


def trie(rows):
    """The nodes of rebuilt conversations, from the definition."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    base = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(base(c), [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(made[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("cells,ranges", [(1 << 20, 1), (1 << 20, 9), (12, 1), (40, 5), (1, 3)])
def test_prefix_trie_against_brute_force(spark, cells, ranges):
    from grovekit.llm.prefix_trie import prefix_trie

    rng = np.random.default_rng(8)
    rows = []
    for c in range(-30, 130):
        if c % 20 == 0 and c % 3 == 0:
            continue  # classes without a first conversation
        if c % 3 == 0:  # a third are one conversation, but for what others share with it
            turns = [("user", "the same first turn"), ("assistant", "and  one\tanswer"), ("user", "then more")][: 3 - (c % 2)]
        else:
            turns = [(str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b c", "", "d e f"]))) for _ in range(rng.integers(1, 7))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(200, None, "user", "first"), (200, None, None, None), (200, 0, "user", None), (200, 0, "user", None), (200, 0, None, "tie"), (None, 0, "user", "nobody"), (7777, 3, "user", "x")]
    rows += [(301, k, "user", f"long {k % 5}") for k in range(60)] + [(302, k, "user", f"long {k % 5}") for k in range(64)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(6)
    got = prefix_trie(table, cells, ranges)
    assert collections.Counter(map(tuple, got.collect())) == trie(rows)
    if ranges == 1:
        assert prefix_trie(table.filter("false"), cells, ranges).count() == 0


def test_prefix_trie_of_one_hot_conversation(spark, monkeypatch):
    """Equal conversations over many ranges and chunks: the ends of a cut node are hashed in order."""
    from grovekit.llm import prefix_trie as module

    monkeypatch.setattr(module, "CHUNK_BYTES", 63)
    rows = [(c, 0, "user", "hello") for c in range(0, 400 * 20, 20)]
    got = module.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 16, 6)
    assert collections.Counter(map(tuple, got.collect())) == trie(rows)


def whitened(vectors):
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), float)
    mean = fit.mean(axis=0)
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    order = np.argsort(-values)[:4]
    return x, fit, values[order], ((np.array(x, float) - mean) @ axes[:, order]) / np.sqrt(values[order]), values.sum()


def test_whitening_against_brute_force(spark):
    from grovekit.llm.whitening import whiten

    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 9)) * np.array([5, 3, 2, 1.5, 1, 1, 0.5, 0.2, 0.1])).astype(np.float32).astype(float).tolist()
    vectors += [vectors[0]] * 150  # a third are one vector, which counts once
    bad = [None, [None] * 9, [float("nan"), *[0.0] * 8], [float("inf"), *[0.0] * 8], [1.0] * 4, []]
    rows = [(i, v, f"x{i}") for i, v in enumerate(vectors)] + [(10_000 + i, v, "bad") for i, v in enumerate(bad)] + [(None, vectors[1], "null id")]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, N string").repartition(5), carry=["vec_id"])
    x, fit, values, projected, trace = whitened(vectors)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    found = collections.defaultdict(dict)
    for r in got.collect():
        assert r["n"] == n == 300 and r["identity_error"] < 1e-9 and abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-9
        found[r["vec_id"]][r["component"]] = (r["whitened"], r["deviation"])
    assert sorted(found, key=lambda v: -1 if v is None else v) == [None, *range(len(vectors))]
    signs = [np.sign(found[3][k + 1][0] * projected[3, k]) for k in range(4)]
    for i in range(len(vectors)):
        assert np.allclose([found[i][k + 1][0] for k in range(4)], projected[i] * signs, atol=1e-8)
        assert found[i][1][1] == sum((n * a - s) ** 2 for a, s in zip(x[i], sums))
    assert "N" not in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, N string")).columns


def test_whitening_of_few_vectors(spark):
    from grovekit.llm.whitening import whiten

    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], kind)).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12 and line[0]["identity_error"] < 1e-12
    far = whiten(spark.createDataFrame([(i, [i * 1e13, -i * 1e13]) for i in range(5)], kind)).collect()
    assert len(far) == 5 and [r["deviation"] for r in far if r["vec_id"] == 2] == [0] and [r["deviation"] for r in far if r["vec_id"] == 0] == [None]


def test_factor_and_rotations():
    from grovekit.llm.whitening import _rounds, one_sided_jacobi, pivoted_cholesky

    rng = np.random.default_rng(2)
    for d, rank in ((1, 1), (2, 1), (7, 7), (12, 5), (40, 40)):
        b = rng.normal(size=(d, rank)) * 10.0 ** -np.arange(rank).clip(0, 4)
        a = b @ b.T
        factor = pivoted_cholesky(a)
        assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, a, atol=1e-12 * np.trace(a))
        pivots = [int(np.flatnonzero(factor[:, k] == factor[:, k].max())[0]) for k in range(rank) if factor[:, k].max() == np.abs(factor[:, k]).max()]
        assert pivots
        values, vectors = one_sided_jacobi(factor)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:rank], rtol=1e-7, atol=1e-13 * np.trace(a))
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-10) and np.allclose(a @ vectors, vectors * values, atol=1e-10 * np.trace(a))
    assert not pivoted_cholesky(np.zeros((3, 3))).size
    for n in (1, 2, 5, 8):
        pairs = [tuple(sorted(p)) for a, b in _rounds(n) for p in zip(a.tolist(), b.tolist())]
        assert sorted(pairs) == list(itertools.combinations(range(n), 2))


def test_quantised_drops_what_is_not_whole(spark):
    from grovekit.llm.whitening import quantised

    rows = [(1, [0.5, -0.001]), (2, [float("-inf"), 0.0]), (3, [None, 1.0]), (4, None)]
    got = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", F.col("x")).collect()
    assert [tuple(r) for r in got] == [(1, [128, -1])]


def test_names_that_differ_in_case(spark, tmp_path):
    """Columns that equal a result's name in all but case are replaced, as Spark takes them for one."""
    import public_tokenizers

    from grovekit.llm.content_sort import mark_copies
    from grovekit.llm.sharding import shuffle_into_shards
    from grovekit.llm.token_counts import count_tokens
    from grovekit.llm.toxicity import learn, score_documents

    names = ("Score", "PREDICTED", "N_TOKENS", "N_bytes", "Over_Limit", "Shard", "SLOT", "Keep_Id", "Other")
    docs = spark.createDataFrame([(1, "a b", *names), (2, "a  b", *names)], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    for k, df in enumerate((score_documents(docs, learn(docs, labels)), count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/c"), shuffle_into_shards(docs, 2), mark_copies(docs))):
        df.write.parquet(f"{tmp_path}/{k}")
        back = spark.read.parquet(f"{tmp_path}/{k}")
        assert back.count() == 2 and {r["Other"] for r in back.collect()} == {"Other"} and len({c.lower() for c in back.columns}) == len(back.columns)


def test_bands_share_as_often_as_reckoned(spark):
    """Windows that hold just the least allowed part of a template miss all of its bands about as seldom as MISS says."""
    import math

    from grovekit.llm.licenses import CONTAINED, MISS, band_values, bands_for, class_of

    windows = 30_000
    for m in (2, 3, 4, 6):
        s = class_of(m)
        held, bands = math.ceil(CONTAINED * m), bands_for(m, s)
        own = F.array(*[F.xxhash64("id", F.lit(j)) for j in range(m)])
        window = F.concat(F.slice(own, 1, held), F.array(*[F.xxhash64("id", F.lit(1000 + j)) for j in range(2 * s - held)]))
        both = spark.range(0, windows, 1, 4).select(band_values(own, bands).getField("value").alias("a"), band_values(window, bands).getField("value").alias("b"))
        same = F.exists(F.arrays_zip("a", "b"), lambda x: x["a"] == x["b"])
        assert both.filter(~same).count() <= 3 + 3 * windows * MISS


def test_long_entries_in_blocks(spark, monkeypatch):
    """Near misses that share index entries of more rows than a block: the same links and components as by brute force."""
    from grovekit.llm import jaccard_join as J

    rng = np.random.default_rng(21)
    rows = []
    for i in range(150):
        words = [f"b{k}" for k in range(100)]
        for k in rng.choice(100, int(rng.integers(4, 24)), replace=False):
            words[k] = f"a{k}"
        rows.append((i, " ".join(words)))
    sets = {i: set(t.split()) for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = []
    blocks = J._in_blocks
    monkeypatch.setattr(J, "_in_blocks", lambda entries: cut.append(entries.groupBy("key").count().agg(F.max("count")).first()[0]) or blocks(entries))
    for size in (7, 10**6):
        monkeypatch.setattr(J, "BLOCK_RUN", size)
        links, classes = J.all_links(docs, 1, 85)
        of = {r["cid"]: r["doc_id"] for r in classes.collect()}
        assert len(of) == 150 and {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in links.collect()} == linked
        assert {r["doc_id"]: r["component_id"] for r in J.link_components(docs, 1, 85).collect()} == {i: find(i) for i in sets}
    assert max(cut) > 21 and len(cut) == 4  # both ways of linking, with blocks and without

"""The grammar, the language model and the archives."""

import collections
import math
import zlib

import numpy as np
import pytest

INSULTS = ["zork", "blim", "quag"]


def corpus(n=600):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.zipf(1.3, 60) % 3000]
        toxic = i % 5 == 0
        for k in rng.integers(0, 60, 3) if toxic else ():
            words[k] = INSULTS[rng.integers(3)] + "en"[: rng.integers(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    from grovekit.llm.toxicity import learn, score_documents

    rows, labels = corpus()
    more = [(None, "zork"), (9000, None), (9001, ""), (9002, "word " * 20_000 + "zork blim zork")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + more], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = learn(docs, table)
    got = {r["doc_id"]: r for r in score_documents(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == y for i, y in labels if i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["predicted"] == got[9001]["predicted"] == 0
    assert score_documents(docs.limit(0), model).count() == 0
    assert learn(docs, table.limit(0)).lexicon == {}


def test_grammar_patterns():
    from grovekit.llm.toxicity import FACTORS, THREAT_WEIGHT, Model

    m = Model({"zork": 4.0}, (0.0, 1.0))
    plain, aimed, denied, told = (m.evidence(t) for t in ("the zork here", "you are a zork", "it is not a zork", "the man said zork"))
    assert plain == 4 * FACTORS["epithet"] and aimed > plain > told > denied > 0
    assert m.evidence("zork zork") == pytest.approx(plain + 4 * FACTORS["string"])
    assert m.evidence("you leave. a zork") == plain  # a target counts within its clause alone
    assert m.evidence("zork. zork") == 2 * plain and m.evidence("") == 0
    assert m.evidence("the man said " + "word " * 60 + "zork") == told  # a clause has no greatest length
    for text in ("i will kill you", "we are going to hurt them all", "you will soon burn", "ich werde dich töten", "ich werde töten dich", "je vais te tuer", "you know i'll kill you"):
        assert m.evidence(text) == THREAT_WEIGHT
    for text in ("heavy rain can beat and burn young leaves", "kill", "they kill", "you. kill", "i will go. kill you", "i will kill the old engine and then restart for you"):
        assert m.evidence(text) == 0
    assert 0 < m.evidence("i will never kill you") < THREAT_WEIGHT and 0 < m.evidence("he said i will kill you") < THREAT_WEIGHT


def test_grammar_reads_objects_mentions_and_reports():
    from grovekit.llm.toxicity import FACTORS, THREAT_WEIGHT, Model

    m = Model({"zork": 4.0}, (0.0, 1.0))
    for text in (
        "they will beat the eggs", "i'll shoot you an email", "people will burn their old letters", "you will burn the letters",
        "you are going to kill them", "will you kill the process", "the word", "", ",", '"', "he said",
    ):
        assert m.evidence(text) == 0, text
    names = lambda text: [set(n) for n, _ in m.patterns(text)]
    assert names("the word zork appears in the list") == [{"epithet", "mentioned"}] and m.evidence("the word zork appears") < 0.3
    assert names("some odd old zork") == [{"bare"}] and names("my good old friend zork zork") == [{"bare"}, {"string"}]
    for text in ("i will destroy them , they said", "i will destroy them, said the man", '"i will destroy them" they said', "they said i will destroy them"):
        assert names(text) == [{"threat", "reported"}] and m.evidence(text) == pytest.approx(THREAT_WEIGHT * FACTORS["reported"]), text
    assert names("i said you are a zork") == names("you are a zork, i said") == names("you are a zork") == [{"epithet", "directed"}]
    assert names('he wrote "zork" there') == [{"epithet", "directed", "reported"}] and names('"fine" he is a zork') == [{"epithet", "directed"}]


def test_composed_grammar_is_its_parts_in_sequence():
    from grovekit.llm.toxicity import END, FATE, RECIPIENT, SYMBOLS, grammar, parts

    rng, symbols = np.random.default_rng(4), [*SYMBOLS, RECIPIENT, FATE]
    machine = grammar()
    for _ in range(300):
        line = [int(x) for x in rng.choice(symbols, rng.integers(0, 40))] + [END]
        one_by_one, names = line, [()] * len(line)
        for part in parts():
            out = part.run(one_by_one)
            one_by_one, names = [s for s, _ in out], [a + b for a, (_, b) in zip(names, out)]
        assert machine.run(line) == list(zip(one_by_one, names))


def test_toxicity_learns_plain_counts(spark):
    """Lexicon, factors and curve against the same counts made by loops over the labelled texts."""
    from grovekit.llm.toxicity import CHANCE, FACTOR_ROWS, FACTORS, PURITY, Model, chance_log, explaining, features, fit_curve, learn, words_of

    rows, labels = corpus(900)
    rows = [(i, t + (" you are a zork" if i % 10 == 0 else " the word zork" if i % 97 == 1 else "")) for i, t in rows]
    got = learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    y = dict(labels)
    train = [(t, y[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    n1, n0 = sum(v for _, v in train), sum(1 - v for _, v in train)
    sets = [{f for w in words_of(t) for f in features(w)} for t, _ in train]
    lexicon = {}
    for f in set().union(*(s for s, (_, v) in zip(sets, train) if v)):
        k1, k0 = (sum(f in s for s, (_, v) in zip(sets, train) if v == bad) for bad in (1, 0))
        if k1 / (k1 + k0) >= PURITY and chance_log(k1, k0, n1 / (n1 + n0)) <= math.log(CHANCE):
            lexicon[f] = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    lexicon = explaining(lexicon, [sorted(s & set(lexicon)) for s, (_, v) in zip(sets, train) if v])
    assert got.lexicon == pytest.approx(lexicon) and lexicon
    plain = Model(lexicon, (0.0, 1.0))
    held = [set().union(*(n for n, _ in plain.patterns(t))) for t, _ in train]
    odds = lambda hit: math.log((sum(h * v for h, (_, v) in zip(hit, train)) + 0.5) / (n1 + 1)) - math.log((sum(h * (1 - v) for h, (_, v) in zip(hit, train)) + 0.5) / (n0 + 1))
    whole = odds([bool(h) for h in held])
    for name, fixed in FACTORS.items():
        hit = [name in h for h in held]
        shown = min(2, max(0, odds(hit) / whole))
        assert got.factors[name] == pytest.approx((FACTOR_ROWS * fixed + sum(hit) * shown) / (FACTOR_ROWS + sum(hit)))
    assert got.factors["mentioned"] < 0.2 < got.factors["bare"] and got.factors["threat"] == 1
    weighed = Model(lexicon, (0.0, 1.0), got.factors)
    curve = fit_curve(np.array([weighed.evidence(t) for t, _ in train]), np.array([float(v) for _, v in train]))
    assert got.curve == pytest.approx(curve, rel=1e-6)


def test_toxicity_of_given_documents(spark):
    """Held-out accuracy on the labelled documents of the smallest tables that have enough of them."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from grovekit.llm.toxicity import op5_toxicity_grammar

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_toxicity_grammar(spark, folder).collect()
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    pos, neg = np.array([s for s, y, _ in held if y]), np.array([s for s, y, _ in held if not y])
    auc = np.mean([(s > neg).mean() + (s == neg).mean() / 2 for s in pos])
    caught, called = sum(p for _, y, p in held if y), sum(p for *_, p in held)
    print(f"held out {len(held)}, toxic {len(pos)}, AUC {auc:.3f}, recall {caught / len(pos):.3f}, precision {caught / called:.3f}")
    assert auc > 0.85 and caught / len(pos) > 0.7 and caught / called > 0.95


def brute_model(texts, d=0.6, least=2):
    counts = collections.Counter()
    tok = [[*(w.decode() for w in (t or "").encode().lower().split()), "</e>"] for t in texts]
    for t in tok:
        s = ["<s>", *t]
        counts.update((w,) for w in t)
        for k in (2, 3):
            counts.update(tuple(s[j : j + k]) for j in range(len(s) - k + 1))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    kept = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
    whole = lambda h: len(texts) if h == ("<s>",) else counts[h] if len(h) == 1 else kept.get(h, 0)
    taken = collections.Counter()
    for g, c in kept.items():
        if whole(g[:-1]):
            taken[g[:-1]] += (c - d) / whole(g[:-1])

    def p(g):
        if len(g) == 1:
            return ((counts[g] if g != ("<s>",) else 0) + 0.5) / (n + 0.5 * (v + 1))
        low, h = p(g[1:]), g[:-1]
        return low if not whole(h) else max(kept.get(g, 0) - d, 0) / whole(h) + (1 - taken[h]) * low

    return p, n, {g[0] for g in counts if len(g) == 1}


@pytest.mark.parametrize("parts, least", [(5, 2), (1, 1), (23, 1), (None, 3)])
def test_language_model(spark, parts, least):
    from grovekit.llm.language_model import build, score_texts

    texts = [t for _, t in corpus(200)[0]] + [None, "", "once ONLY", "once only"] + ["the same words " * 3] * 4
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    asked = [*texts[:20], None, "", "unseen words w1 w2 w1 w2", "w1 " * 3000, "the same words the same"]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(asked)], "doc_id long, text string, held_out boolean")
    p, n, known = brute_model(texts, least=least)
    for r in score_texts(docs, build(train, parts=parts, least=least)).collect():
        t = [*(w.decode() for w in (asked[r["doc_id"]] or "").encode().lower().split()), "</e>"]
        s = ["<s>", *t]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in known for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(p((w,))) for w in t), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(tuple(s[max(0, j - 2) : j + 1]))) for j in range(1, len(s))), abs=0.0006 * len(t) + 1e-6)
    assert score_texts(docs.limit(0), build(train.limit(0), parts=2)).count() == 0
    assert {r["score"] for r in score_texts(docs, build(train.limit(0), parts=2)).collect()} == {r["base_score"] for r in score_texts(docs, build(train.limit(0), parts=2)).collect()}


def test_elias_fano():
    from grovekit.llm.language_model import EliasFano

    rng = np.random.default_rng(1)
    for top, n in ((1 << 64, 1000), (1 << 64, 1), (10**12, 5000), (1 << 40, 1000)):
        v = np.unique(np.concatenate([rng.integers(0, top, n, dtype=np.uint64), np.arange(5000, 9000, dtype=np.uint64)]))
        e, q = EliasFano.of(v, top), rng.integers(0, top, 2000, dtype=np.uint64)
        assert (e.find(v) == np.arange(len(v))).all()
        assert (e.find(q) == np.where(np.isin(q, v), np.searchsorted(v, q), -1)).all()
        assert (e.access(np.arange(len(v))).astype(np.uint64) == v).all()
    assert (EliasFano.of(np.empty(0, np.uint64), 10).find(q) == -1).all()
    steps = np.cumsum(rng.integers(0, 3, 3000) * rng.integers(0, 2, 3000)).astype(np.uint64)  # with equal neighbours
    assert (EliasFano.of(steps, int(steps[-1]) + 1).access(np.arange(3000)).astype(np.uint64) == steps).all()


def test_salvage():
    import gzip

    from grovekit.llm.warc import record_bytes, salvage

    def record(i, body):
        import hashlib

        return record_bytes(i, "http://x/ y\n", body, len(body), hashlib.sha1(body).hexdigest(), None)

    plain = [record(i, b"WARC/1.1\r\n body %d " % i * 50) for i in range(5)]
    members = [gzip.compress(r, mtime=0) for r in plain]
    for parts in (plain, members):
        whole = b"".join(parts)
        assert [x[2] for x in salvage(whole)] == [None] * 5
        edges = np.cumsum([0, *map(len, parts)])
        bad = bytearray(whole)
        bad[edges[1] + len(parts[1]) // 2] ^= 0xFF
        got = list(salvage(bytes(bad)))
        assert sum(x[3] is not None for x in got) == 4 and [(a, b) for a, b, why, *_ in got if why] == [(edges[1], edges[2])]
        cut = list(salvage(whole[: edges[4] + 30]))
        assert sum(x[3] is not None for x in cut) == 4 and cut[-1][:2] == (edges[4], edges[4] + 30)
        junk = list(salvage(b"junk" + whole))
        assert junk[0][:2] == (0, 4) and len(junk) == 6
    assert list(salvage(b"")) == []


def test_warc_round_trip(spark, tmp_path):
    import hashlib

    from grovekit.llm.warc import plan_revisits, read_warc, write_warc

    big = "x" * 2000
    rows = [(1, "u", big), (2, "u", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "é" * 600), (7, "u", "é" * 600), (8, "a\r\nb: c", "<html>" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/warc"
    assert write_warc(plan_revisits(pages), folder, archive_bytes=500).agg({"records": "sum"}).first()[0] == len(rows)
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read_warc(spark, folder).collect())
    want = collections.Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        ref = 2 if i == 1 else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref else "response", ref] += 1
    assert got == want
    write_warc(plan_revisits(pages.limit(0)), f"file://{tmp_path}/none")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from grovekit.llm.decontamination import contamination
    from grovekit.llm.toxicity import learn, score_documents

    rows, labels = corpus(200)
    rows = [(i, f"{t} tail{i} tail{i + 1} tail{i + 2}") for i, t in rows]
    bad = " ".join(f"bench{i}" for i in range(12))
    rows += [(500, rows[1][1]), (501, rows[2][1] + " end"), (502, f"some {bad} text"), (503, None), (504, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
        seen.append({r["doc_id"] for r in left.collect()})
    model = learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert seen[0] == {r["doc_id"] for r in score_documents(docs, model).filter("predicted = 0").collect()}
    assert {1, 2} <= seen[1] and not {500, 501} & seen[1]
    assert seen[1] - seen[2] == {502} == {r["doc_id"] for r in contamination(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[2]

"""Operators against brute-force versions on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(120))
NEAR = BASE.replace("tok60 ", "other ")
TEXTS = [
    (0, BASE), (1, BASE), (2, NEAR), (3, BASE.upper()), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (8, "ONE  two"), (9, LONG),
    (10, LONG + " more"), (11, "Héllo wörld, it's  fine. 3 4"), (12, "x"), (12, "x"), (None, "no id here at all"), (13, NEAR.replace("tok10 ", "else ")),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard string, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_token_counts(spark, docs, none, tmp_path):
    import public_tokenizers
    import sentencepiece

    from grovekit.llm.token_counts import count_tokens, read_cache

    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = counted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in TEXTS)
    for _ in range(2):  # the second time all are in the cache
        assert counted(count_tokens(docs, path, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
        assert read_cache(spark, cache).count() == len({t or "" for _, t in TEXTS})
    assert count_tokens(none, path, cache).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from grovekit.llm.packing import END_ID, cuts, pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = pack_documents(docs, path).collect()
    lengths = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
        lengths[r["doc_id"]] += r["length"]
    for found in pieces.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at and n > 0
            at += n
        assert at <= 4096
    ids = collections.defaultdict(list)
    for i, t in TEXTS:
        ids[i].append(model.encode(t or "", add_special_tokens=False).ids + [END_ID])
    assert lengths == {i: sum(map(len, v)) for i, v in ids.items()}
    for r in rows:
        whole = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        part = np.array(whole[0][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert pack_documents(none, path).count() == 0
    for n in (1, 127, 128, 129, 4095, 4096, 4097, 10_000):
        assert sum(x for _, x in cuts(n)) == n and all(k * x <= 4096 for k, x in cuts(n))


def test_encoders_agree_with_libraries():
    import public_tokenizers as P

    from grovekit.llm.encoders import PieceCounter, WordIds

    odd = ["", " ", "  ", "a ", "a  b", " a\n b  ", "\n", "a▁b", "x \n y", "a\x1cb c", "e ́a", "<s> hi</s>", "<|endoftext|> ok", "don't  it's", "A\tB\r\nC", "_a1b2_", "ÀÉ»x«"]
    pieces, words = PieceCounter(P.path("piece_bpe_32k.model"), memory=3), WordIds(P.path("word_bpe_49k.json"), memory=3)
    for _ in range(2):
        assert pieces.count(odd) == pieces.whole(odd)
        assert [list(x) for x in words.ids(odd)] == words.whole(odd)
        assert [list(x) for t in odd for x in words.ids([t])] == words.whole(odd)


def test_encoders_on_mixed_signs():
    import public_tokenizers as P

    from grovekit.llm.encoders import PieceCounter, WordIds

    known = ["He said, “Hello,” and left.", "„Ja!“ sagte er.", "«Bonjour!» dit-il.", "(5 €)", "“yes.”", "wait…, what", "x!'s", "it's!", "!'ll", "'t's", "=\u0338 <\u0338>", "a;\u037e", "\u212a!x", "İ.i̇", "\x1c!a", "3!4²!½"]
    rng = np.random.default_rng(11)
    signs = [*"abcxyzST09", *"!-.,;:'\"()=<>_`~", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\u00a0", "\u2028", "é", "É", "ß", "İ", "Σ", "я", "中", "“", "”", "’", "…", "—", "€", "²", "½", "\u0301", "\u0338", "\u037e", "\u200b", "😀", "▁", "'s", "'ll", "n't", "<|endoftext|>"]
    odd = known + ["".join(signs[k] for k in rng.integers(0, len(signs) - (i % 20 > 0), int(rng.integers(1, 14)))) for i in range(6000)]
    pieces, words = PieceCounter(P.path("piece_bpe_32k.model")), WordIds(P.path("word_bpe_49k.json"))
    assert pieces.count(odd) == pieces.whole(odd)
    whole = words.whole(odd)
    assert [list(x) for x in words.ids(odd)] == whole
    assert [list(x) for t in odd[:500] for x in words.ids([t])] == whole[:500]


@pytest.mark.parametrize("block_rows", [1000, 2])
def test_sharding(docs, none, block_rows):
    from grovekit.llm.sharding import shuffle_into_shards

    got = shuffle_into_shards(docs.select("doc_id", "text"), 5, block_rows=block_rows).collect()
    assert counted((r["doc_id"], r["text"]) for r in got) == counted(TEXTS)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {len(v) for v in slots.values()} <= {len(TEXTS) // 5, len(TEXTS) // 5 + 1}
    assert shuffle_into_shards(none, 5).count() == 0


def test_communication_matrix():
    from grovekit.llm.sharding import communication_matrix

    m = communication_matrix([5, 0, 7, 30], [11, 11, 10, 10], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7, 30] and m.sum(axis=0).tolist() == [11, 11, 10, 10]
    big = communication_matrix([10**9, 2 * 10**9], [15 * 10**8, 15 * 10**8], 1)
    assert big.sum(axis=0).tolist() == [15 * 10**8] * 2


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return counted((d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_jaccard_join(spark, docs, none):
    from grovekit.llm.jaccard_join import link_components, one_of_each

    assert counted(link_components(docs).collect()) == components(TEXTS)
    rng = np.random.default_rng(3)
    rows = []
    for g in range(6):  # groups of near copies, some of them large, with a passage that all share
        words = [f"g{g}w{i}" for i in rng.integers(0, 500, 150)] + [f"shared{i}" for i in range(25)]
        for _ in range(30 if g < 2 else 4):
            w = list(words)
            for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[k] = f"new{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    assert counted(link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()) == components(rows)
    assert link_components(none).count() == 0
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for d, _, c in components(TEXTS) if d is not None})


def test_top_k(spark):
    from grovekit.llm.topk import top_k

    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 24)) / 5)]
    rows += [(200, rows[3][1]), (900, None), (901, [1.0, None]), (902, [float("nan")]), (903, [float("inf")]), (None, [1.0]), (300, rows[300][1]), (1000, []), (1100, [50.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    usable = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    pad = lambda v: np.pad(v, (0, 24 - len(v)))
    want = collections.Counter()
    for a, (q, x) in enumerate(usable):
        if q % 100 == 0:
            s = sorted((-int(pad(x) @ pad(y)), i) for b, (i, y) in enumerate(usable) if b != a)[:10]
            want.update((q, r + 1, i, -n) for r, (n, i) in enumerate(s))
    assert counted(top_k(df, F.col("vec_id") % 100 == 0, block_rows=100, query_rows=2).collect()) == want
    for seed in (1, 40, 400):
        assert counted(top_k(df, F.col("vec_id") % 100 == 0, block_rows=64, query_rows=3, seed_rows=seed).collect()) == want
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_decontamination(spark, docs, none):
    from grovekit.llm.decontamination import contamination, phrases, search, without_contaminated

    items = [(1, " ".join(f"TOK{i}" for i in range(20, 34))), (10, "one two"), (2, "tok1 tok2"), (3, None), (4, " , "), (None, "wörld it s fine"), (5, "héllo wörld"), (6, "absent words only"), (7, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    want, near = collections.Counter(), collections.Counter()
    total = collections.Counter(w for _, t in TEXTS for w in words(t))
    for d, t in TEXTS:
        w, hit, found, close = words(t), set(), set(), set()
        for i, text in items:
            v = words(text)
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                p = v[k : k + n]
                anchor = min(range(n), key=lambda j: (total[p[j]], j))
                for at in range(len(w)):
                    if w[at : at + n] == p:
                        hit.update(range(at, at + n))
                        found |= {str(i)} if i is not None else set()
                    if w[at] == p[anchor] and all(x in w[max(0, at - anchor + j - 2) : max(0, at - anchor + j + 3)] for j, x in enumerate(p)):
                        close |= {str(i)} if i is not None else set()
        want[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(close)] += 1
    assert counted(contamination(docs, bench).collect()) == want
    assert contamination(none, bench).count() == 0
    assert not contamination(docs, bench.limit(0)).filter("contaminated").count()
    assert without_contaminated(docs, bench).columns == docs.columns
    assert phrases(bench, 10).count() == 5 + 1 + 1 + 1 + 1 + 1 + 1

    ten = [f"t{i}" for i in range(10)]
    moved = [*ten[:4], "a", "b", *ten[4:]]
    far = [*ten[:4], "a", "b", "c", *ten[4:]]
    rows = [(1, ten), (2, moved), (3, far), (4, [*ten[:4], "other", *ten[5:]]), (5, [*ten[:3], ten[4], ten[3], *ten[5:]])]
    # t0 is the rarest term: all others stand once more in a text of their own
    one = spark.createDataFrame([(i, " ".join(w)) for i, w in [*rows, (6, ten[1:])]], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(ten))], "item_id long, text string")
    assert sorted(map(tuple, search(one, asked).select("doc_id", "start", "length", "off").collect())) == [(1, 0, 10, 0), (2, 0, 10, 12), (5, 0, 10, 2)]
    assert [r["doc_id"] for r in search(one, asked, slop=0).collect()] == [1]


def test_licenses(spark, docs, none):
    from grovekit.llm.licenses import TEMPLATES, bands_for, class_of, scan_licenses

    rows = [(1, "a b. Licensed under the Apache License, Version 2.0."), (2, "LICENSED UNDER CC BY-NC 4.0 " + LONG), (3, None), (4, ""), (5, "released under the mit license"), (6, "released under a mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["template_id"]) for r in scan_licenses(df, TEMPLATES).collect()} == {(1, "apache-2.0"), (2, "cc-by-nc-4.0"), (5, "mit")}
    assert scan_licenses(none, TEMPLATES).count() == 0 and scan_licenses(docs, TEMPLATES).count() == 0
    assert scan_licenses(df, {}).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(df, {"x": "MIT License"})
    for m in range(1, 40):  # the chance of a miss at the least containment
        s = class_of(m)
        held = -(-8 * m // 10)
        assert s == 1 or (1 - held / (2 * s + m - held)) ** bands_for(m, s) <= 1e-4


def test_whole_license_texts(spark):
    """Every template's own text, one with some words changed and a part of it, against brute force."""
    from grovekit.llm.licenses import CONTAINED, SHINGLE, TEMPLATES, class_of, scan_licenses

    rng = np.random.default_rng(2)
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    rows = []
    for text in TEMPLATES.values():
        w = words(text)
        changed = list(w)
        for k in rng.integers(0, len(w), max(1, len(w) // 60)):
            changed[k] = "other"
        filler = [f"f{k}" for k in rng.integers(0, 900, 700)]
        for body in (w, changed, w[: len(w) * 3 // 4], w[len(w) // 8 :]):
            at = int(rng.integers(0, 600))
            rows.append((len(rows) % 90, " ".join([*filler[:at], *body, *filler[at:]])))
    want = collections.Counter()
    grams = lambda w: [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
    best = {}
    for d, text in rows:
        g = grams(words(text))
        for k, v in TEMPLATES.items():
            own = set(grams(words(v)))
            s = class_of(len(own))
            for b in range(0, len(g), s if s > 1 else 1):
                held = len(own & set(g[b : b + (2 * s if s > 1 else 1)])) / len(own)
                if held >= CONTAINED:
                    best[d, k] = max(held, best.get((d, k), 0))
                    want[d, k] += 1
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), TEMPLATES).collect()
    assert {(r["doc_id"], r["template_id"]): (round(r["containment"], 9), r["n_windows"]) for r in got} == {k: (round(best[k], 9), n) for k, n in want.items()}
    assert len(want) > 60

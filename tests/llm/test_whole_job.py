"""Whole results: cases that a shorter job would leave out."""

import zlib

import numpy as np
import pytest


def near(a, b, size, percent):
    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}

    x, y = shingles(a), shingles(b)
    return 100 * len(x & y) >= percent * len(x | y)


def leaders(rows, size, percent):
    """The smallest id of each row's component."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if near(a, b, size, percent):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def near_copies():
    """A text and a beginning of it, or a text with some words changed, on both sides of 0.80 at five words."""
    rows = []
    for g, k in enumerate((166, 161, 160, 155)):  # 162, 157, 156 and 151 of 196 shingles
        words = [f"g{g}w{i}" for i in range(200)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:k]))]
    words = [f"h{i}" for i in range(204)]
    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:164]))]  # 160 of 200: just 0.80
    for g, n in enumerate((4, 5, 6, 4, 5, 6)):
        words = [f"e{g}w{i}" for i in range(240 + g)]
        rows.append((len(rows), " ".join(words)))
        for k in np.linspace(10, len(words) - 10, n).astype(int):
            words[k] = f"new{g}n{k}"
        rows.append((len(rows), " ".join(words)))
    return rows


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = leaders(rows, 5, 80)
    assert want[1] == 0 and want[3] == 2 and want[5] == 5 and want[7] == 7 and want[9] == 8
    assert {r["doc_id"] for r in corpus_pipeline.jaccard_join(spark, docs, "").collect()} == set(want.values())


def test_warc_long_urls(spark, tmp_path):
    from grovekit.llm.warc import plan_revisits, read_warc, write_warc

    rows = [(1, "http://x/" + "q" * 70_000, "a"), (2, "data:," + " " * 40_000, "b"), (3, "http://x/", "c")]
    folder = f"file://{tmp_path}/warc"
    write_warc(plan_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), folder)
    got = {r["page_id"]: r["url"] for r in read_warc(spark, folder).filter("gap_reason is null").collect()}
    assert got == {i: url.replace(" ", "%20") for i, url, _ in rows}


def member(n, level=6, size=300, digest=True):
    import gzip
    import hashlib

    from grovekit.llm.warc import record_bytes

    rng = np.random.default_rng(n)
    records = []
    for i in range(n):
        body = rng.bytes(size).hex().encode()
        record = record_bytes(i, f"http://x/{i}", body, len(body), hashlib.sha1(body).hexdigest(), None)
        records.append(record if digest else record.replace(b"WARC-Block-Digest", b"X-Was-Digest"))
    return records, lambda parts=records: gzip.compress(b"".join(parts), level, mtime=0)


def read(data):
    from grovekit.llm.warc import salvage

    found = list(salvage(data))
    at = 0
    for start, end, *_ in found:  # every byte is covered, in order
        assert start <= at <= end
        at = end
    assert at == len(data)
    pages = [int(x[3]["warc-record-id"][12:-1]) for x in found if x[3]]
    return pages, [(x[0], x[1], x[2], x[5]) for x in found if x[2]]


@pytest.mark.parametrize("held", [1 << 26, 1000])
def test_salvage_within_members(monkeypatch, held):
    from grovekit.llm import warc

    monkeypatch.setattr(warc, "HELD_BYTES", held)  # the smaller one: members are expanded again in parts
    for level, size in ((6, 300), (0, 300), (6, 90_000)):
        records, packed = member(6, level, size)
        whole, edges = packed(), np.cumsum([0, *map(len, records)]).tolist()
        assert read(whole) == ([*range(6)], [])
        for k in (0, 2, 5):  # a wrong block digest in a sound member
            parts = list(records)
            parts[k] = parts[k].replace(b"HTTP/1.1 200", b"HTTP/1.1 300")
            data = packed(parts)
            assert read(data) == ([i for i in range(6) if i != k], [(0, len(data), "block digest", (edges[k], edges[k + 1]))])
            behind = read(data + whole)
            assert behind[0] == [i for i in range(6) if i != k] + [*range(6)]
        for cut in (1, 8):  # cut in the trailer: all the content is there
            pages, gaps = read(whole[:-cut])
            assert pages == [*range(6)] and {g[2] for g in gaps} <= {"member cut short"}
        cut = whole[: len(whole) * 2 // 3]
        known = len(zlib.decompressobj(31).decompress(cut))
        pages, gaps = read(cut)
        assert pages == [i for i in range(6) if edges[i + 1] <= known] and len(pages) > 2 and gaps[-1][2] == "member cut short"
        bad = bytearray(whole)
        bad[-6] ^= 1  # the checksum
        assert read(bytes(bad) + whole)[0] == [*range(6)] * 2
        bad = bytearray(whole)
        at = len(whole) * 2 // 3
        bad[at] ^= 0xFF  # the data
        known = len(zlib.decompressobj(31).decompress(whole[:at]))
        sure = [i for i in range(6) if edges[i + 1] <= known]
        pages, gaps = read(whole + bytes(bad) + whole)
        assert pages[:6] == pages[-6:] == [*range(6)] and pages[6 : 6 + len(sure)] == sure and 14 < len(pages) < 18 and gaps
    records, packed = member(6, digest=False)  # nothing but the member's checksum vouches for these
    bad = bytearray(packed())
    bad[-6] ^= 1
    assert read(packed())[0] == read(packed()[:-1])[0] == [*range(6)] and read(bytes(bad))[0] == []


def test_salvage_within_members_as_rows(spark, tmp_path):
    from grovekit.llm.warc import read_warc

    records, packed = member(5)
    records[2] = records[2].replace(b"HTTP/1.1 200", b"HTTP/1.1 300")
    (tmp_path / "a.warc.gz").write_bytes(packed(records))
    (tmp_path / "b.warc.gz").write_bytes(member(5)[1]()[:-1])
    rows = read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r["page_id"] for r in rows if not r["gap_reason"]) == [0, 0, 1, 1, 2, 3, 3, 4, 4]
    a = len(records[0]) + len(records[1])
    assert [(r["member_from"], r["member_to"]) for r in rows if r["gap_reason"] == "block digest"] == [(a, a + len(records[2]))]


def test_all_links(spark):
    from grovekit.llm.jaccard_join import all_links, link_counts

    rng = np.random.default_rng(4)
    base, rows = [f"w{i}" for i in range(175)], []
    for i in range(40):  # more near copies than are compared with each other for their component
        w = list(base)
        for k in rng.integers(0, len(w), int(rng.integers(0, 6))):
            w[k] = f"new{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, "one two"), (53, "one two"), (54, "alone"), (55, None), (56, ""), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(i, sum(bool(a and b) and m != n and near(a, b, 4, 85) for m, (_, b) in enumerate(rows))) for n, (i, a) in enumerate(rows)]
    by = lambda found: sorted(map(tuple, found), key=repr)
    assert by(link_counts(docs).collect()) == by(want) and sum(n for _, n in want) > 400
    links, members = all_links(docs)
    texts, cid = {i: t for i, t in rows}, {r["cid"]: r["doc_id"] for r in members.filter("doc_id is not null and cid is not null").collect()}
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert got == {(a, b) for a in cid for b in cid if a < b and near(texts[cid[a]], texts[cid[b]], 4, 85)}

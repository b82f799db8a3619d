"""SimHash, packing, token counts, WARC and the two classifiers against plain Python."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from streamloom.llm import graph, language_id, packing, quality_model, simhash, token_counts, tokens, warc
from streamloom.llm.common import salted_left_join

from .data import components, documents, fingerprint, nasty, one_of_each, prose

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_simhash_against_all_pairs(spark):
    rows = nasty()
    for seed in range(12):
        base = prose(random.Random(seed), 150).split(" ")
        for k in range(6):
            copy = list(base)
            copy[k * 3] += "x"
            rows.append((200 + seed * 10 + k, " ".join(copy)))
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs).collect()
    want = components(rows)
    assert Counter((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got) == Counter(want)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == one_of_each(rows)
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.fingerprint(None) == fingerprint("") == 0
    assert simhash.fingerprint("a" * 300_000) == fingerprint("a" * 300_000)


def test_large_files_in_chunks(spark, monkeypatch):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    marks = {base}
    while len(marks) < 400:
        x = rng.choice(sorted(marks))
        for _ in range(rng.randrange(1, 5)):
            x ^= 1 << rng.randrange(64)
        marks.add(x)
    marks = np.array(sorted(marks), np.uint64)
    links = simhash.forest_of_large(marks)
    assert len(links) < len(marks)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    table = spark.createDataFrame([(int(x),) for x in marks.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in graph.components(simhash.link_fingerprints(table)).collect()}
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3
    label = np.arange(len(marks))
    while True:
        least = np.where(near, label[None, :], len(marks)).min(axis=1)
        if (least == label).all():
            break
        label = least
    groups = {}
    for x, k in zip(marks.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(k, set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {500: 500, 501: 500}
    assert got == want


def test_salted_join(spark):
    left = spark.createDataFrame([(i % 3 if i < 90 else None, i) for i in range(100)], "k bigint, v bigint")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, w string")
    got = {(r.k, r.v, r.w) for r in salted_left_join(left, right, "k", left.v, hot_rows=7).collect()}
    assert got == {(r.k, r.v, r.w) for r in left.join(right, "k", "left").collect()}


def test_near_duplicates_are_dropped_by_row(spark):
    text = [prose(random.Random(900 + k), 80) for k in range(7)]
    rows = [(5, text[0]), (7, text[0]), (2, text[1]), (5, text[1])]  # 5 goes as a copy of 2, not as itself
    rows += [(None, text[k]) for k in (2, 3, 4, 4)] + [(None, text[5]), (8, text[5]), (9, text[6]), (9, text[6])]
    assert len({c for _, _, c in components([(k, t) for k, (_, t) in enumerate(rows)])}) == 7
    got = Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(documents(spark, rows)).collect())
    want = [(5, text[0]), (2, text[1]), *[(None, text[k]) for k in (2, 3, 4)], (8, text[5]), (9, text[6])]
    assert got == Counter(want) == one_of_each(rows)


def test_unrelated_texts_under_one_id_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    text = [prose(random.Random(700 + k), 80) for k in range(4)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (2, text[0])]
    got = Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(documents(spark, rows)).collect())
    assert got == Counter([(1, text[0]), (1, text[1]), (None, text[2]), (None, text[3])]) == one_of_each(rows)


def test_packing_covers_every_token_once(spark):
    rows = nasty() + [(300 + i, prose(random.Random(i), 40 * (i % 9))) for i in range(60)]
    docs = documents(spark, rows)
    got = packing.pack(docs, WORD_BPE, cut="free").collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    unit = Counter()
    for (doc, _), own in zip(rows, ids, strict=True):
        unit[(doc, len(own), zlib.crc32(own.tobytes()))] += 1
    total = sum(map(len, ids))
    assert sum(r.length for r in got) == total
    pieces, windows = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
        assert any(
            r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
            for (doc, _), own in zip(rows, ids, strict=True)
            if doc == r.doc_id
        )
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= packing.SEQUENCE
    assert len(windows) == -(-total // packing.SEQUENCE)
    wanted = Counter()
    for doc, _ in rows:
        wanted[doc] += 1
    assert {d: sum(r.start == 0 for r in p) for d, p in pieces.items()} == dict(wanted)
    assert packing.pack(documents(spark, []), WORD_BPE, cut="free").count() == 0


def _index(docs, width):
    """A shard's index and the corpus-wide BM25 score of each pair, by definition."""
    n, lengths = len(docs), np.array([len(d) for d in docs])
    df = np.bincount(np.concatenate([np.unique(d[:-1]) for d in docs]), minlength=width)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = max(1.0, (lengths - 1).mean())
    found = [np.unique(d[:-1], return_counts=True) for d in docs]
    weights = packing.Weights(np.dtype("<u4"), idf, mean)
    packed = [packing.pa.array([x[i].astype(k).tobytes() for x in found], packing.pa.binary()) for i, k in ((0, "<u4"), (1, "<u2"))]
    term, weight, size = weights.of(*packed, packing.pa.array(lengths))
    score = np.zeros((n, n))
    for j, (terms, tf) in enumerate(found):
        for t, f in zip(terms, tf, strict=True):
            norm = packing.K1 * (1 - packing.B + packing.B * (lengths[j] - 1) / mean)
            for i in range(n):
                if t in found[i][0]:
                    score[i, j] += idf[t] * f * (packing.K1 + 1) / (f + norm)
    return packing.ShardIndex(term, weight, size, width), score


def _replay(lengths, score, seeds_at_once, top):
    """The greedy packing in plain Python, one grant at a time."""
    n, left = len(lengths), int(sum(lengths))
    used, windows, full, done = set(), [[None, None, 0, []] for _ in range(seeds_at_once)], 0, []

    def place(w, doc):
        nonlocal full, left
        used.add(doc)
        left -= int(lengths[doc])
        start, before = 0, full
        while start < lengths[doc]:
            m = min(int(lengths[doc]) - start, packing.SEQUENCE - w[2])
            w[3].append((doc, start, m, w[2]))
            start, w[2] = start + m, w[2] + m
            if w[2] == packing.SEQUENCE:
                done.extend((d, s, k, full, o) for d, s, k, o in w[3])
                full, w[2], w[3] = full + 1, 0, []
                w[0], w[1] = (doc if start < lengths[doc] else None), doc
        return full != before

    while left:
        wanted = sum(packing.SEQUENCE - w[2] for w in windows if w[0] is not None)
        for w in windows:
            while w[0] is None and left and (wanted + packing.SEQUENCE <= left or not wanted):
                w[0] = w[1] = min(set(range(n)) - used)
                place(w, w[0])
                wanted += packing.SEQUENCE - w[2] if w[0] is not None else 0
        asking = {w[0]: w for w in windows if w[0] is not None}
        pairs = []
        for seed, w in asking.items():
            own = []
            for doc in set(range(n)) - used:
                tie = packing._TIES[doc + seed * 40_503 % (1 << 16)]
                value = np.round(np.float32(score[w[1], doc]) / np.float32(packing.STEP)) * np.float32(packing.STEP) + tie
                own.append((-float(np.float32(value)), seed, doc))
            pairs += sorted(own)[:top]
        for _, seed, doc in sorted(pairs):
            if seed in asking and doc not in used and place(asking[seed], doc):
                del asking[seed]
    return done, [x for w in windows for x in w[3]]


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 60, 500) for k in range(1, 9)]
    docs = [np.append(rng.choice(topics[k % 8], 500), 2) for k in range(64)]
    index, brute = _index(docs, 1000)
    got = index.scores([np.unique(d[:-1]) for d in docs])
    assert np.allclose(got, brute, rtol=1e-4)
    assert set(np.argsort(-got[0])[:8].tolist()) == set(range(0, 64, 8))
    lengths = np.array([len(d) for d in docs])
    windows = {}
    for k, *_, sequence, _ in packing.pack_documents(lengths, index):
        windows.setdefault(sequence, []).append(k % 8)
    pure = [Counter(w).most_common(1)[0][1] / len(w) for w in windows.values()]
    assert sum(pure) / len(pure) > 0.7


def test_packing_replayed_greedily(monkeypatch):
    """The pieces of every full window are those of a plain replay over brute-force scores."""
    rng = np.random.default_rng(8)
    docs = [np.append(rng.integers(0, 400, rng.integers(1, 90) * (1 + k % 4)), 2) for k in range(90)]
    docs += [docs[k].copy() for k in range(8)] + [np.array([2])] * 3
    monkeypatch.setattr(packing, "SEQUENCE", 512)
    monkeypatch.setattr(packing, "COLUMNS", 32)
    monkeypatch.setattr(packing, "RUN", 4)
    # a coarse step, so that no rounding of sums decides
    monkeypatch.setattr(packing, "_TIES", (packing._TIES / packing.STEP * 0.05).astype(np.float32))
    monkeypatch.setattr(packing, "STEP", 0.05)
    brute = _index(docs, 400)[1]
    lengths = np.array([len(d) for d in docs])
    top = max(16, 8 * 512 * len(docs) // int(lengths.sum()))
    for rounds in (1, 4, 1000):
        monkeypatch.setattr(packing, "ROUNDS", rounds)
        seeds = max(1, min(packing.OPEN, int(lengths.sum()) // 512 // rounds))
        done, rest = _replay(lengths, brute, seeds, top)
        got = packing.pack_documents(lengths, _index(docs, 400)[0])
        assert set(done) <= set(got)
        assert sum(p[2] for p in got) == lengths.sum()
        assert Counter(p[0] for p in got if p[1] == 0) == Counter(range(len(docs)))
        assert sum(p[2] for p in got if p not in set(done)) == sum(p[2] for p in rest)


def test_best_of_rows():
    rng = np.random.default_rng(2)
    for n in (1, 7, 64, 300, 5000):
        score = rng.random((5, n)).astype(np.float32)
        score[:, ::3] = -np.inf
        at, value = packing.best(score, 16)
        want = -np.sort(-score, axis=1)[:, :16]
        assert np.array_equal(-np.sort(-value, axis=1), want)
        assert np.array_equal(np.take_along_axis(score, at, axis=1), value)


def test_shards_are_dealt_by_size(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100)
    monkeypatch.setattr(packing, "SHARD_DOCS", 10)
    x = np.repeat(np.eye(4, packing.DIMS, dtype=np.float32), 16, axis=0)
    router = packing.Router(x, 4)
    leaf = router.leaf(x)
    assert sorted(Counter(leaf.tolist()).values()) == [16] * 4 and len(set(leaf[:16].tolist())) == 1
    assert packing.Router(x[:20] * 0, 8).leaves == 1
    first, second = (packing.Router.leaf(packing.Router(x[:40], n), x[:40]) for n in (1, 2))
    assert set(first.tolist()) == {0} and set(second.tolist()) == {0, 1}
    router.below, router.root = [(1, 2), (-1, -2), (-3, -4)], 0
    assert packing.deal(router, [(1, 30), (2, 60), (1, 20), (3, 250)]) == [(0, 1), (0, 1), (1, 1), (2, 3)]
    assert packing.deal(router, [(1, 3), (2, 6), (1, 2), (3, 25)]) == [(0, 1)] * 4
    assert packing.deal(router, [(0, 0), (25, 9), (9, 9), (1, 9)]) == [(0, 1), (1, 3), (4, 1), (4, 1)]


@pytest.fixture
def topical(spark, monkeypatch):
    """Documents of twelve topics, and as many shards of a few thousand tokens."""
    words = [f"{a}{b}" for a in ("sun", "rain", "stone", "leaf", "bird", "road") for b in ("er", "ing", "ly", "able")]
    rows = []
    for k in range(240):
        rng, topic = random.Random(k), random.Random(k % 12)
        own = [topic.choice(words) + chr(97 + topic.randrange(26)) * 2 for _ in range(60)]
        rows.append((10_000 + 977 * k, " ".join(rng.choice(own) for _ in range(150))))
    monkeypatch.setattr(packing, "SHARD_TOKENS", 12_000)
    return rows


def test_packing_over_shards(spark, topical):
    rows = topical + [(5, topical[0][1])] * 90 + [(None, None), (7, "")]
    got = packing.pack(documents(spark, rows).repartition(4), WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in rows}
    total = sum(len(ids[d]) for d, _ in rows)
    assert total > 5 * packing.SHARD_TOKENS and sum(r.length for r in got) == total
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
    by_shard = Counter()
    for s, spans in windows.items():
        by_shard[s >> 32] += sum(n for _, n in spans)
    assert len(by_shard) > 5 and max(by_shard.values()) < 2.5 * packing.SHARD_TOKENS
    assert len(windows) == sum(-(-n // packing.SEQUENCE) for n in by_shard.values())
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(d for d, _ in rows)


def test_packing_search_recall(spark, topical):
    """Of the ten best neighbours in the whole corpus, at least 0.9 lie in the seed's own shard."""
    rows = topical
    tokenizer = Tokenizer.from_file(WORD_BPE)
    docs = [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for _, t in rows]
    coded = spark.createDataFrame(
        [(k, d.astype("<u2").tobytes(), len(d), *_packed(d)) for k, d in enumerate(docs)], f"doc_id bigint, {packing.CODED}"
    ).withColumn("number", packing.F.col("doc_id"))
    width = tokenizer.get_vocab_size()
    df = np.bincount(np.concatenate([np.unique(d[:-1]) for d in docs]), minlength=width)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    lengths = np.array([len(d) for d in docs])
    weights = packing.Weights(np.dtype("<u2"), idf, (lengths - 1).mean())
    found = packing.with_shards(coded, weights, len(docs), int(lengths.sum())).collect()
    shard = np.array([r.shard for r in sorted(found, key=lambda r: r.doc_id)])
    assert len(set(shard.tolist())) > 5
    sums = [np.unique(d[:-1], return_counts=True) for d in docs]
    norm = packing.K1 * (1 - packing.B + packing.B * (lengths - 1) / (lengths - 1).mean())
    vectors = np.zeros((len(docs), width), np.float32)
    for k, (t, f) in enumerate(sums):
        vectors[k, t] = idf[t] * f * (packing.K1 + 1) / (f + norm[k])
    score = (vectors > 0).astype(np.float32) @ vectors.T
    np.fill_diagonal(score, -1)
    nearest = np.argsort(-score, axis=1)[:, :10]
    assert (shard[nearest] == shard[:, None]).mean() >= 0.9


def _packed(ids):
    terms, counts = np.unique(ids[:-1], return_counts=True)
    return terms.astype("<u2").tobytes(), counts.astype("<u2").tobytes()


def test_token_counts_and_cache(spark, tmp_path):
    rows = nasty()
    docs = documents(spark, rows)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, BYTE_BPE, "led", cache).collect()
        assert Counter(tuple(r) for r in got) == want
    stored = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(documents(spark, []), BYTE_BPE, "led").count() == 0


@pytest.mark.parametrize(("path", "cut"), [(BYTE_BPE, "led"), (WORD_BPE, "free"), (BYTE_BPE, "whole")])
def test_pieces_equal_the_library(path, cut, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 300)
    monkeypatch.setattr(tokens, "MEMO_IDS", 300)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(tokens, "LIST_CHARS", 2000)
    rng = random.Random(7)
    parts = [".", ",", " ", "  ", "\n", "a", "B", "Z.", "é", "É.", "'s", "'S", "don't", "<|endoftext|>", "<|END", "\x1c",
             " ", "3", "12.5", "!?.", "...", "ΑΣ ", "́", "日本", "\t", "word", "Word, ", "İ", "ß", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    own = tokens.Encoder(path, cut)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert list(own.counts(texts)) == list(map(len, want))
    assert [np.frombuffer(x, own.kind).tolist() for x in own.ids(texts)] == want


def test_warc_round_trip(spark):
    rows = [
        (5, "u", "a\r\n\r\nb"),
        (3, "v\r\nX: y", "a\r\n\r\nb"),
        (3, "v2", "a\r\n\r\nb"),
        (9, None, None),
        (2, "w", ""),
        (None, "z", "a\r\n\r\nb"),
        (7, "q", "é" * 10_000),
        (8, "only", "WARC/1.1\r\n\r\n"),
        (None, "lone", "nothing else like this"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    got = warc.archive(pages).collect()
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        first = least.get(html or "")
        revisit = first is not None and i != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(i, len(data), digest, "revisit" if revisit else "response", first if revisit else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert warc.archive(pages.limit(0)).count() == 0
    long_only = warc.archive(pages, min_bytes=100).collect()
    assert {r.record_type for r in long_only} == {"response"}


def test_warc_null_ids_beside_one_page(spark):
    rows = [(4, "a"), (None, "a"), (None, "a"), (-1, "b"), (None, "b"), (None, "c"), (None, "c"), (6, "d")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id bigint, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    want = [(4, "response", None), (-1, "response", None), (6, "response", None)]
    want += [(None, "revisit", 4)] * 2 + [(None, "revisit", -1)] + [(None, "response", None)] * 2
    assert got == Counter(want)


def test_archives_of_gzip_members(spark, tmp_path, monkeypatch):
    big = random.Random(1).randbytes(9_000_000).hex()  # its record needs two members, its file is larger than others
    rows = [(1, "u", big), (2, "u", "a"), (None, "v", big), (3, "w", "b" * 100_000)] + [(k, "u", f"page {k}") for k in range(10, 90)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=2000)
    got = {(r.page_id, r.record_type, bytes(r.payload or b"").decode()) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {(i, "revisit" if i is None else "response", "" if i is None else t) for i, _, t in rows}
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    members = list(warc._gunzip(whole))
    assert len(members) == len(rows) + 1 and gzip.decompress(whole) == b"".join(members)
    assert len(list((tmp_path / "w").glob("part-*"))) > 5
    monkeypatch.setattr(warc, "MEMBER_BYTES", 8)
    for n in range(30):
        record = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n)
        assert [b for _, b in warc._whole_records(warc._members(record) * 3)] == [b"x" * n] * 3
    with pytest.raises(ValueError):
        list(warc._whole_records(warc._members(record)[:-3]))


def test_broken_archives_are_errors():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse_records(good * 2)] == [b"ab", b"ab"]
    for bad in (good[:-2], b"rubbish\r\n\r\n", good.replace(b"2", b"3")):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse_records(bad))


def _languages(n):
    out = []
    for k in range(n):
        rng = random.Random(k)
        a = "abcdefghijklm" if k % 2 else "nopqrstuvwxyz"
        tail = {0: "éa", 1: "ça", 2: "ñ"}[k % 3]
        out.append((k, " ".join("".join(rng.choice(a) for _ in range(5)) + tail for _ in range(60)), f"l{k % 2}{k % 3}"))
    return out


def test_language_codes(spark):
    rows = _languages(240)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, score string")
    model = language_id.fit(df)
    got = language_id.predict(df, model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    odd = documents(spark, [(1, None), (2, ""), (3, "123 !?"), (None, "abc"), (4, "m" * 200_000), (4, "m" * 200_000)])
    seen = language_id.predict(odd, model).collect()
    assert {r.doc_id: r.lang_pred for r in seen if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert len(seen) == 6 and all(0 <= r.score <= 1 for r in seen)
    assert language_id.predict(documents(spark, []), model).count() == 0
    none = language_id.fit(df.where("lang is null"))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    single = language_id.fit(df.where("lang = 'l00'"))
    assert language_id.predict(df, single).first().lang_pred == "l00"


def test_language_sample_is_of_different_texts(spark, monkeypatch):
    rows = [(k, f"word{k} and the text {k * 7}", "aa") for k in range(200)]
    rows += [(1000 + k, ("ganz kurze worte", "noch ein satz")[k % 2], "bb") for k in range(600)]
    sizes = []
    fitted = language_id.CodeModel.fit
    monkeypatch.setattr(language_id.CodeModel, "fit", lambda m, x, y: (sizes.append(np.bincount(y).tolist()), fitted(m, x, y)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = language_id.fit(docs, sample_rows=20)
    assert model.languages == ["aa", "bb"] and sizes == [[10, 2]]


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 20])
def test_codebooks_correct_errors(n):
    code = language_id.codebook(n)
    distances = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(distances) >= (1 if n == 2 else 2 if n == 3 else 3)


def test_quality_model(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        rows.append((k, prose(rng, 80) if good else " | ".join(rng.choice("abc") * 3 for _ in range(80))))
        labels.append((k, int(good), 0, "x"))
    labels += [(None, 1, 0, "x"), (5, None, 0, "x"), (999, 1, 0, "x"), (6, 1, 0, "x")]
    docs = documents(spark, rows + [(1000, None), (1001, ""), (None, "x"), (1, rows[1][1])])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string")
    model = quality_model.fit(docs, table)
    got = quality_model.score(docs, model).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) / len(held) > 0.97
    kept = quality_model.keep_good(docs, model)
    assert kept.dtypes == docs.dtypes
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)
    none = quality_model.fit(docs, table.limit(0))
    assert {r.score for r in quality_model.score(docs, none).collect()} == {0.5}
    alike = quality_model.fit(docs, table.where("quality = 1"))
    assert all(r.score > 0.9 for r in quality_model.score(docs, alike).collect())
    assert quality_model.score(documents(spark, []), model).count() == 0


def test_pairs_catch_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.AdditiveModel(0.5)
    model.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95

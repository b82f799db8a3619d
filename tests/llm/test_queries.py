"""Every ``opN_`` query over a folder of small hostile tables, against plain Python."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from streamloom.llm import language_id, packing, quality_model, queries

from .data import components, documents, hits, nasty, prose, quality, sha256

SAID = r"\### Assistant: </turn> ok"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The rows of small tables, and the folder that holds them."""
    rng = random.Random(12)
    passages = [(k, prose(rng, 30)) for k in range(5)] + [(5, None), (None, prose(rng, 20)), (6, "two words")]
    rows = nasty(3) + [(400 + k, prose(random.Random(k), 60 + k % 50)) for k in range(80)]
    rows += [(500 + k, rows[-1 - k][1]) for k in range(6)]
    rows += [(600 + k, " | ".join(prose(random.Random(k), 60).split())) for k in range(40)]
    rows += [(700 + k, f"{passages[k % 5][1]} {prose(rng, 80)} {passages[(k + 1) % 5][1]} {SAID}") for k in range(6)]
    rows += [(800 + k, "²½ 12 ¾ !?" if k else "١٢٣") for k in range(2)]  # digits, but no letter
    spoken = {i: ("fr" if i is not None and i % 3 == 0 else "en") for i, _ in rows}
    rows = [(i, None if t is None else t.replace("e", "é") if spoken[i] == "fr" else t) for i, t in rows]
    docs = [(i, t, spoken[i] if k % 7 else None) for k, (i, t) in enumerate(rows)]
    pages = [(k, "u", f"<p>{k % 9}") for k in range(40)] + [(99, None, None), (98, "v", ""), (None, "w", "<p>1"), (3, "x", "y" * 90_000)]
    labels = [(i, int(not 600 <= i < 700), 0) for i, _ in rows if i is not None] + [(None, 1, 0), (3, None, 1)]
    turns = [(c, t, ["user", "assistant", None][t % 3], [None, SAID, "<|end|>\\l", ""][(c + t) % 4]) for c in range(8) for t in range(70)]
    folder = str(tmp_path_factory.mktemp("tables"))

    def write(name, values, schema):
        spark.createDataFrame(values, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")

    write("documents", docs, "doc_id bigint, text string, lang string")
    write("benchmark", passages, "item_id bigint, text string")
    write("pages", pages, "page_id bigint, url string, html string")
    write("labels", labels, "doc_id bigint, quality int, toxic int")
    write("conversations", turns, "conv_id bigint, turn bigint, role string, text string")
    return {"rows": rows, "docs": docs, "items": passages, "pages": pages, "labels": labels, "turns": turns, "folder": folder}


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_op1(spark, tables):
    want = Counter()
    for i, t in tables["rows"]:
        n, hit, found = hits(t, tables["items"])
        want[(i, n, hit, len(found), sha256(",".join(found)), len(found) >= 2)] += 1
    assert Counter(tuple(r) for r in queries.op1_decontaminate(spark, tables["folder"]).collect()) == want


def test_op2(spark, tables):
    got = queries.op2_quality_rules(spark, tables["folder"]).collect()
    want = Counter((i, *quality(t).values()) for i, t in tables["rows"])
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert not any(r.kept for r in got if r.doc_id is not None and 600 <= r.doc_id < 700)


def test_op3(spark, tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in tables["rows"]]
    got = queries.op3_packing(spark, tables["folder"]).collect()
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((i, len(x)) for i, x in ids)
    of = defaultdict(list)
    for i, x in ids:
        of[i, len(x)].append(x)
    windows = defaultdict(list)
    for r in got:
        cuts = [zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in of[r.doc_id, r.doc_tokens]]
        assert r.ids_crc32 in cuts
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= packing.SEQUENCE
    assert len(windows) == -(-sum(len(x) for _, x in ids) // packing.SEQUENCE)


def test_op4(spark, tables):
    """Predictions equal those of a plain reading of the fitted bits; held-out rows are told right."""
    docs = spark.read.parquet(f"{tables['folder']}/documents.parquet")
    model = language_id.fit(docs)
    want = Counter()
    for i, t in tables["rows"]:
        if t is None or not any(c.isalpha() for c in t):
            want[(i, held_out(i), "und")] += 1
            continue
        data = f" {t.lower()} ".encode()
        counts = Counter()
        for n, odd in ((2, 2654435761), (3, 2246822519)):
            for k in range(len(data) - n + 1):
                counts[(int.from_bytes(data[k : k + n], "little") * odd) % 2**32 >> 20] += 1
        total = sum(counts.values())
        margin = [
            float(model.bias[b]) + sum(math.sqrt(c / total) * float(model.weights[k, b]) for k, c in counts.items())
            for b in range(model.code.shape[1])
        ]
        loss = [
            sum(float(model.trust[b]) * math.log1p(math.exp(-m * int(word[b]))) for b, m in enumerate(margin))
            for word in model.code
        ]
        want[(i, held_out(i), model.languages[loss.index(min(loss))])] += 1
    got = queries.op4_language_id(spark, tables["folder"]).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred) for r in got) == want
    assert all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in tables["docs"] if i is not None and i >= 400 and i < 800}
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 15 and sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.9 * len(held)


def test_op5(spark, tables):
    said = defaultdict(list)
    for c, t, role, text in tables["turns"] + [(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]:
        said[c].append((t, role or "", text or ""))
    want = {}
    for c, turns in said.items():
        turns.sort()
        loss = "".join(text for _, role, text in turns if role == "assistant")
        want[c] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha256(loss))
    got = queries.op5_chat_format(spark, tables["folder"]).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert len(got) == len(want)


def test_op6(spark, tables):
    least = {}
    for i, _, html in tables["pages"]:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = Counter()
    for i, _, html in tables["pages"]:
        data, first = (html or "").encode(), least.get(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first is not None and i != first
        want[(i, len(data), digest, "revisit" if revisit else "response", first if revisit else None)] += 1
    got = queries.op6_warc(spark, tables["folder"]).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_op7(spark, tables):
    got = queries.op7_simhash(spark, tables["folder"]).collect()
    assert Counter(tuple(r) for r in got) == Counter(components(tables["rows"]))


def test_op8(spark, tables):
    got = queries.op8_shuffle(spark, tables["folder"]).collect()
    data = [(i, (t or "").encode()) for i, t in tables["rows"]]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(x) + 1, zlib.crc32(x)) for i, x in data)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sorted(slots) == list(range(16))
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_op9(spark, tables):
    """Scores equal a plain sum of looked-up values; held-out rows are told right."""
    folder = tables["folder"]
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    model = quality_model.fit(docs, labels)
    got = queries.op9_quality_model(spark, folder).collect()

    def bin_of(edges, x):
        return sum(e <= x for e in edges)

    want = []
    for i, t in tables["rows"]:
        x = quality_model.describe(t)
        total = model.base + sum(v[bin_of(e, x[k])] for k, (e, v) in enumerate(zip(model.edges, model.tables, strict=True)))
        for (a, b), v in zip(model.pairs, model.pair_tables, strict=True):
            total += v[bin_of(model.pair_edges[a], x[a]), bin_of(model.pair_edges[b], x[b])]
        want.append((-1 if i is None else i, held_out(i), round(1 / (1 + math.exp(-total)), 9)))
    assert Counter((-1 if r.doc_id is None else r.doc_id, r.held_out, round(r.score, 9)) for r in got) == Counter(want)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and 400 <= r.doc_id < 800]
    assert len(held) > 15 and sum(r.predicted == (not 600 <= r.doc_id < 700) for r in held) > 0.9 * len(held)


def test_op10(spark, tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in tables["rows"]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert Counter(tuple(r) for r in queries.op10_token_counts(spark, tables["folder"]).collect()) == want


def test_shards_are_uniform(spark, monkeypatch):
    """Over many seeds a row meets every shard, every slot and every other row as often as chance has it."""
    from streamloom.llm import shuffle

    monkeypatch.setattr(shuffle, "PIECE_ROWS", 3)
    docs = documents(spark, [(k, f"t{k % 4}") for k in range(12)], clash=False).select("doc_id", "text").coalesce(1).cache()
    trials, shard, slot, meet = 60, Counter(), Counter(), 0
    for seed in range(trials):
        rows = {r.doc_id: (r.shard, r.slot) for r in shuffle.shard(docs, 3, seed).collect()}
        shard.update((d, s) for d, (s, _) in rows.items())
        slot.update((d, n) for d, (_, n) in rows.items())
        meet += sum(rows[a][0] == rows[b][0] for a in range(12) for b in range(a))
    for seen, cells, mean in ((shard, 36, trials / 3), (slot, 48, trials / 4)):
        chi = sum((seen[d, k] - mean) ** 2 / mean for d in range(12) for k in range(cells // 12))
        assert chi < cells + 5 * math.sqrt(2 * cells)
    assert meet == trials * 3 * 6  # sizes are exact, so as many pairs share a shard in every draw

"""Decontamination, quality rules, chat format and sharding against plain Python."""

import random
from collections import Counter

import pytest

from streamloom.llm import chat_format, decontaminate, quality_rules, shuffle

from .data import documents, hits, nasty, prose, quality


def test_quality_rules_against_python(spark):
    rows = nasty() + [
        (20, "Nav | bar | one | two\n" + prose(random.Random(3), 80)),
        (21, "\n".join(["Home | About | News | Contact"] * 30) + "\n" + prose(random.Random(4), 60)),
        (22, "All rights reserved.\n" + prose(random.Random(5), 80)),
        (23, "".join(f"word{i}### " for i in range(100))),
    ]
    docs = documents(spark, rows)
    got = quality_rules.assess(docs).collect()
    want = Counter((i, *quality(t).values()) for i, t in rows)
    names = list(quality("").keys())
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert [by_id[i].kept for i in (20, 21, 22, 23, 6, 9, 1)] == [True, False, True, False, True, True, False]
    assert by_id[22].cleaned == rows[-2][1].split("\n", 1)[1]
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    out = kept.collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in got if r.kept)
    assert all(r.n_chars == len(r.text) for r in out)


def test_many_repeated_windows(spark):
    rng = random.Random(8)
    rows = []
    for k in range(30):
        words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice([3, 4, 5, 60, 400]))]
        rows.append((k, " ".join(words)))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.assess(documents(spark, rows)).collect()}
    assert got == {k: quality(t)["n_repeat_words"] for k, t in rows}


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_python(spark, monkeypatch, broadcast):
    rng = random.Random(1)
    passage, other = prose(rng, 40), prose(rng, 12)
    items = [
        (1, passage),
        (2, other),
        (2, other),
        (3, "quiet garden"),
        (10, passage),
        (5, None),
        (6, ""),
        (None, prose(rng, 20)),
        (7, "one two three four five six seven"),
        (8, "Straße"),
    ]
    docs = nasty() + [
        (30, prose(rng, 100) + " " + passage.upper() + " " + prose(rng, 100)),
        (31, " ".join(passage.split()[5:13])),
        (32, " ".join(passage.split()[5:12])),
        (33, "One, two; three four five SIX seven eight"),
        (34, items[7][1]),
        (35, "a quiet garden, quiet garden " + other),
        (36, other + " " + passage),
        (36, other + " " + passage),
    ]
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ENTRIES", 0)
    table = documents(spark, docs)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, fp string")
    want = Counter()
    for i, t in docs:
        n, hit, found = hits(t, items)
        want[(i, n, hit, len(found), ",".join(found), len(found) >= 2)] += 1
    got = decontaminate.find_hits(table, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == want
    clean = decontaminate.drop_contaminated(table, bench)
    assert clean.columns == table.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, t in docs if len(hits(t, items)[2]) < 2)


def test_empty_tables(spark):
    docs, bench = documents(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_hits(docs, bench).count() == 0
    some = documents(spark, [(1, "a b c d e f g h i")])
    assert [r.n_hit for r in decontaminate.find_hits(some, bench).collect()] == [0]
    assert quality_rules.assess(docs).count() == 0
    assert shuffle.shard(docs).count() == 0
    turns = spark.createDataFrame([], f"conv_id bigint, turn bigint, role string, parts {chat_format.PART_TYPE}")
    assert chat_format.read_back(chat_format.format_conversations(turns)).count() == 0


def test_chat_round_trip_and_parts(spark):
    hostile = ["<|end|>", "\\l \\b \\\\ <|turn|>user<|text|>", "<", "a<|", "|>", "", None, "<|image|>", "é\U0001f600\n"]
    rows = [(c, t, role, hostile[(c + t) % len(hostile)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant"] * 3)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} <|end|>") for t in range(300)]
    rows += [(60, 1, "assistant", "b"), (60, 1, "assistant", "a"), (60, None, None, "first"), (None, 0, "<|text|>", "x")]
    rows += [(61, 1, "user", "same"), (61, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("parts", chat_format.text_part(df.text)).withColumn("block", df.text)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns == "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert got[c].loss == "".join(text for _, role, text in turns if role == "assistant")


def test_chat_placeholders(spark):
    parts = [
        ("text", "see <|image|> ", None, None),
        ("image", None, "s3/a.png", None),
        ("audio", None, "b.wav", 7),
        ("text", " and", None, None),
        ("document", None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts {chat_format.PART_TYPE}")
    row = chat_format.format_conversations(df).first()
    assert row.formatted == "<|turn|>user<|text|>see \\limage|> <|image|><|audio|> and<|document|><|end|>"
    assert [tuple(a) for a in row.attachments] == [("image", "s3/a.png", 256), ("audio", "b.wav", 7), ("document", None, 1024)]
    assert row.loss_spans == []


def test_hostile_parts_come_back(spark):
    """Types, roles and texts that look like marks are told from marks, and attachments stay with their turn."""
    bad = ["end", "turn", "text ", "<|end|>", "image|><|end", "", "IMAGE", "part", "image", "audio", "document"]
    rng = random.Random(5)
    turns = []
    for c in range(6):
        for t in range(90):
            parts = [
                ("text", rng.choice(["<|image|>", "\\l", "a", "", "<", "|>", "<|text|>", None]), None, None)
                if rng.random() < 0.5
                else (rng.choice(bad), None, f"ref{c}/{t}/{k}", rng.choice([None, 5]))
                for k in range(rng.randrange(5))
            ] + ([(None, "no type", None, None)] if t % 9 == 0 else [])
            turns.append((c, t, rng.choice(["user", "assistant", "<|text|>", None]), parts))
    df = spark.createDataFrame(turns, f"conv_id bigint, turn bigint, role string, parts {chat_format.PART_TYPE}")
    blocks = chat_format.format_conversations(df)
    got = {}
    for r in chat_format.read_parts(blocks).collect():
        got[r.conv_id, r.block * 64 + r["at"]] = (r.role, [tuple(p) for p in r["parts"]])
    tokens = {"image": 256, "audio": 150, "document": 1024}
    for c, t, role, parts in turns:
        want = []
        for kind, text, ref, n in parts:
            if kind in (None, "text"):
                if want and want[-1][0] == "text" and want[-1][2] is None and want[-1][1] is not None:
                    want[-1] = ("text", want[-1][1] + (text or ""), None, None)
                elif text:
                    want.append(("text", text, None, None))
            else:
                want.append((kind, None, ref, n or tokens.get(kind, 1)))
        assert got[c, t] == (role or "", want)
    assert len(got) == len(turns)
    back = {r.conv_id: r.n_turns for r in chat_format.read_back(blocks).collect()}
    assert back == dict.fromkeys(range(6), 90)


def test_shards(spark):
    import zlib

    rows = nasty() + [(100 + i, f"text {i % 7}") for i in range(900)]
    docs = documents(spark, rows)
    got = shuffle.shard(docs).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted(map(len, slots.values()))
    assert sizes[-1] - sizes[0] <= 1
    again = Counter(tuple(r) for r in shuffle.shard(docs).collect())
    assert again == Counter(tuple(r) for r in got)
    few = shuffle.shard(documents(spark, rows[:3])).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_communication_matrix_margins_and_law():
    rng = random.Random(2)
    for seed in range(20):
        counts = [rng.randrange(0, 400) for _ in range(9)]
        sizes = shuffle.shard_sizes(sum(counts), 5)
        matrix = shuffle.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in matrix] == counts
        assert [sum(c) for c in zip(*matrix, strict=True)] == sizes
    draws = [shuffle.draw_hypergeometric(random.Random(s), 30, 100, 20) for s in range(4000)]
    mean = sum(draws) / len(draws)
    assert mean == pytest.approx(6.0, abs=0.1)
    assert sum((d - mean) ** 2 for d in draws) / len(draws) == pytest.approx(20 * 0.3 * 0.7 * 80 / 99, rel=0.1)
    assert all(shuffle.draw_hypergeometric(random.Random(s), 5, 8, 6) in (3, 4, 5) for s in range(50))

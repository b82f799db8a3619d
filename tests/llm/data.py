"""Small hostile tables, and plain-Python versions of the operators."""

import hashlib
import random
import re
from collections import Counter

import xxhash

WORDS = "the of and river stone cloud mountain quiet yellow window table garden letter number silver".split()
#: Columns whose names the operators use inside.
CLASHES = {
    name: "x"
    for name in (
        "fp", "n_words", "shard", "len", "component_id", "digest", "ids", "lines", "n", "key", "_verdict", "_qr_m",
        "_text_hash", "text_hash", "slot", "score", "kept", "copies", "_gone_id", "_qr_kept", "_bad_id", "w", "h", "id",
    )
}


def prose(rng, n):
    """Sentences in lines, ``n`` words."""
    out = []
    for k in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "ly", "ing", "er", str(rng.randrange(50))])
        out.append(word + ("." if k % 9 == 8 else "") + ("\n" if k % 27 == 26 else " "))
    return "".join(out).strip() + "."


def nasty(seed=0):
    rng = random.Random(seed)
    long = prose(rng, 30_000)
    one = prose(rng, 120)
    near = one.replace("river", "rivers", 1)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "Ünïcode ßtraße \U0001f600 ÉCOLE école"),
        (5, "short text"),
        (6, one),
        (7, one),
        (8, near),
        (9, long),
        (10, prose(rng, 200)),
        (10, "another text under the same id " + prose(rng, 60)),
        (11, prose(rng, 90)),
        (11, prose(random.Random(99), 90)),
        (12, "again and again " * 60),
        (12, "again and again " * 60),
        (13, "x" * 50_000),
        (14, "a\\b <| <|end|> \\l </s> <|endoftext|> \\### Assistant:"),
        (None, prose(rng, 70)),
        (None, None),
    ]
    return rows


def documents(spark, rows, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if clash else df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    words = white_words(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    marks = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def _roots(rows):
    """Each row's fingerprint and the root row of its component, by comparing all pairs."""
    marks = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return marks, [find(i) for i in range(len(rows))]


def components(rows):
    """Smallest id of each row's component."""
    marks, root = _roots(rows)
    least = {}
    for r, (doc, _) in zip(root, rows, strict=True):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{m:016x}", least.get(r)) for (doc, _), m, r in zip(rows, marks, root, strict=True)]


def one_of_each(rows):
    """The row of the smallest id, nulls last, of each component."""
    best = {}
    for k, (r, (doc, _)) in enumerate(zip(_roots(rows)[1], rows, strict=True)):
        best[r] = min(best.get(r, (True, 0, 0)), (doc is None, doc or 0, k)) if r in best else (doc is None, doc or 0, k)
    return Counter(rows[k] for _, _, k in best.values())


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def hits(text, items):
    """(n_words, n_hit, sorted item ids) of a text by looking at every window."""
    words, hit, found = item_words(text), set(), set()
    for item, body in items:
        own = item_words(body)
        size = min(8, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def quality(text):
    """The base measures of the line rules."""
    text = text or ""
    words = white_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if white_words(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
    }


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()

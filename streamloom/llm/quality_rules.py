"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: navigation bars, boilerplate, symbol noise and
short unpunctuated fragments fail and are removed.  A document is then rejected
when a base rule fails or when the removed lines held too much of its text.

Windows of three words are told apart by 64-bit hashes, inside one text only.

Defined results: a null text is an empty one (no words, rejected); a very long
text is measured whole; repeated rows are judged alike, one result row each; a null id stays null; an empty
table gives an empty result; extra columns are ignored by ``assess`` and kept
untouched by ``filter_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

SPACE = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
FOUR_WORDS = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){3}[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
SUSPECT = r"[#*$%&|<>»›•·]"
TERMINAL = r"[.!?…:;,)\]\"'”’»。！？؟][\x20\x09-\x0D]*$"
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "copyright",
    "cookie",
    "terms of use",
    "privacy policy",
    "subscribe",
    "javascript",
    "click here",
    "lorem ipsum",
)
#: A boilerplate line is short: a phrase inside a paragraph does not make one.
BOILERPLATE_WORDS = 30
NAVIGATION_SEPARATORS = 3
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A document loses too much when its failed lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 40


def has_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """True if the lower-cased text holds one of ``phrases``."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return found


def line_fails(line: Column, suspect: Column, told: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """True for a line with a word that any line rule removes.

    ``suspect`` and ``told`` say whether the whole text has a separator or
    symbol, or one of ``phrases``; most texts have none, and skip those rules.
    """

    def n_words() -> Column:
        return F.size(F.array_remove(F.split(line, SPACE), ""))

    separators = F.regexp_count(line, F.lit(SEPARATORS))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    noise = F.rlike(line, F.lit(SUSPECT)) & (
        ((separators >= NAVIGATION_SEPARATORS) & (separators * 4 >= n_words()))
        | ((symbols >= 4) & ((symbols * 5 >= F.length(line)) | (symbols * 2 >= n_words() * 3)))
    )
    boilerplate = let(F.lower(line), lambda x: has_phrase(x, phrases)) & (n_words() <= BOILERPLATE_WORDS)
    fragment = ~F.rlike(line, F.lit(FOUR_WORDS)) & ~F.rlike(line, F.lit(TERMINAL))
    return (suspect & noise) | (told & boilerplate) | fragment


def _covered(places: Column) -> Column:
    """Words under 3-word windows at the ascending ``places``: each covers up to the next place."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(places) - 2),
        lambda k: F.least(F.get(places, k + 1) - F.get(places, k), F.lit(3)),
    )
    total = F.aggregate(gaps, F.lit(3), lambda a, x: a + x)
    return F.when(F.size(places) == 0, 0).when(F.size(places) == 1, 3).otherwise(total)


def _repeat_words(hashes: Column, twice: Column) -> Column:
    """Words inside windows whose hash is in ``twice``.

    A few such hashes are looked up at each position; many are found by sorting (hash, position) pairs.
    """
    few = F.filter(
        F.sequence(F.lit(0), F.size(hashes) - 1),
        lambda i: F.array_contains(twice, F.get(hashes, i)),
    )

    def flagged(p: Column) -> Column:
        alike = F.filter(
            p,
            lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]),
        )
        return F.sort_array(F.transform(alike, lambda x: x["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return (
        F.when(F.size(twice) == 0, 0)
        .when(F.size(twice) <= 24, let(few, _covered))
        .otherwise(let(let(pairs, flagged), _covered))
    )


def _measure(docs: DataFrame, text_col: str, phrases: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with helper columns, and the measures as expressions over them.

    The steps stay separate projections, as each is used more than once; so the
    sorts run as compiled code on primitive arrays.
    """
    text, words, hashes, ordered, twice, lines = (
        fresh(docs, f"_qr_{x}") for x in ("text", "words", "hashes", "ordered", "twice", "lines")
    )
    w, h, o = F.col(words), F.col(hashes), F.col(ordered)
    n = F.size(w)
    # bound by let: a plain column used once would be computed again for each line
    of_text = F.struct(
        F.rlike(F.col(text), F.lit(SUSPECT)).alias("suspect"),
        let(F.lower(F.col(text)), lambda x: has_phrase(x, phrases)).alias("told"),
    )

    def judged(t: Column) -> Column:
        return F.transform(
            F.split(F.col(text), "\n"),
            lambda x: let(
                F.rlike(x, F.lit(HAS_WORD)),
                lambda has: F.struct(
                    x.alias("line"), has.alias("has"), (has & line_fails(x, t["suspect"], t["told"], phrases)).alias("fails")
                ),
            ),
        )

    step = (
        docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
        .withColumn(words, F.array_remove(F.split(F.col(text), SPACE), ""))
        .withColumn(
            hashes,
            F.when(n < 4, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), n - 3),
                    lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
                )
            ),
        )
        .withColumn(ordered, F.sort_array(h))
        .withColumn(twice, F.array_distinct(F.filter(o, lambda x, k: x == F.get(o, k - 1))))
        .withColumn(lines, let(of_text, judged))
    )
    each = F.col(lines)
    removed = F.transform(F.filter(each, lambda x: x["fails"]), lambda x: x["line"])
    worded = F.transform(F.filter(each, lambda x: x["has"]), lambda x: x["line"])
    stay = F.transform(F.filter(each, lambda x: ~x["fails"]), lambda x: x["line"])
    measures = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(h, F.col(twice)).cast("long"),
        "n_lines_removed": F.size(removed).cast("long"),
        "lost_chars": F.length(F.regexp_replace(F.array_join(removed, "\n"), SPACE, "")).cast("long"),
        "cleaned": F.array_join(stay, "\n"),
    }
    name = fresh(step, "_qr_m")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    measured = step.select(*kept, F.struct(*[c.alias(k) for k, c in measures.items()]).alias(name))
    return measured, {k: F.col(name)[k] for k in measures}


def _base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)


def _lost(m: dict[str, Column]) -> Column:
    return m["lost_chars"] * 100 > m["word_chars"] * MAX_LOST_PERCENT


def assess(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[str, ...] = BOILERPLATE
) -> DataFrame:
    """One row per document: the base measures, the cleaned text and the verdict.

    ``phrases`` are the boilerplate phrases in lower case, in whatever languages the corpus has.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    measured, m = _measure(slim, "text", phrases)
    base_failed = _base_failed(m)
    return measured.select(
        "doc_id",
        *[m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed.alias("base_failed"),
        (~base_failed & ~_lost(m)).alias("kept"),
        *[m[k].alias(k) for k in ("n_lines_removed", "lost_chars", "cleaned")],
    )


def filter_documents(
    docs: DataFrame,
    text_col: str = "text",
    chars_col: str | None = "n_chars",
    phrases: tuple[str, ...] = BOILERPLATE,
) -> DataFrame:
    """The kept documents with their cleaned text, in the columns of ``docs``.

    ``chars_col``, where ``docs`` has it, is set to the length of the cleaned text.
    """
    measured, m = _measure(docs, text_col, phrases)
    # a filter would be pushed below and compute every measure again; a generator is not
    name, verdict = fresh(measured, "_qr_kept"), measured.columns[-1]
    kept = measured.withColumn(
        name, F.explode(F.when(~_base_failed(m) & ~_lost(m), F.array(F.col(verdict)["cleaned"])))
    )
    m = {"cleaned": F.col(name)}
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(m["cleaned"].alias(c))
        elif c == chars_col:
            out.append(F.length(m["cleaned"]).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return kept.select(*out)

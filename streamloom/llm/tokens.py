"""Tokenizers on the executors, with a bounded memo of pieces.

A text is cut where the tokenizer surely cuts it, so each piece can be encoded
by the library alone, and repeated pieces only once per block or worker.  How a
tokenizer cuts is read from its file:

* ``led``: byte-level BPE, where a single space between non-spaces starts the
  next piece and belongs to it; a point or comma between an ASCII letter and
  such a space is a token of its own;
* ``free``: vocabularies in lower case that drop white space, where any space
  parts pieces; a point or comma between an ASCII letter and white space is
  parted too, and plain ASCII texts are lower-cased first;
* ``whole``: no cutting, for any other tokenizer file.

Ids are made block by block on Arrow arrays: texts are cut and their pieces
dictionary-encoded, each distinct piece is encoded once, and the ids of a block
are gathered from those of its distinct pieces.  Pieces of Latin letters go to
the merges of the model without the steps around them, which leave them as they
are but for lower case and the spelling of bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from tokenizers import Tokenizer

#: Pieces whose count a worker remembers; later ones are encoded again in each block.
MEMO_PIECES = 1_000_000
#: Pieces whose ids a worker remembers, in two Arrow arrays (about 40 MB).
MEMO_IDS = 1_000_000
#: Longer pieces are never remembered.
MEMO_CHARS = 64
#: Characters that are cut into pieces at one time, in Arrow arrays or in lists of texts.
BLOCK_CHARS, LIST_CHARS = 12_000_000, 2_000_000
#: New pieces that go to the library as one text.
JOINED_PIECES = 500

_ODD = re.compile(r"^ | \Z|\s | \s")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
# the sign comes first in these, so that a search runs along the text to the next sign
_LED_CLOSING = re.compile(r"[.,](?<=[A-Za-z].)(?= \S)")
_FREE_CLOSING = re.compile(r"[.,](?<=[A-Za-z].)(?=\s)")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_FREE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FREE_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_loaded: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def cut_of(path: str) -> str:
    """How texts can be cut for this tokenizer file, from its own normalizer, pre-tokenizer and model."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, normal, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback")
    )
    added = any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if not plain or added or spec["truncation"] or spec["padding"]:
        return "whole"
    if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return "whole" if model.get("end_of_word_suffix") else "led"
    steps = pre.get("pretokenizers", [])
    if (
        (normal or {}).get("normalizers") == _FREE_NORMAL
        and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": _FREE_SPLIT}
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and not (steps[1]["use_regex"] or steps[1]["add_prefix_space"])
    ):
        return "free"
    return "whole"


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies spell each byte: printable ones as they are, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


def version_digest(path: str) -> str:
    """Digest of the tokenizer file and of the library that runs it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


def cut_led(text: str) -> tuple[list[str], int]:
    """The pieces of ``text`` without their leading space (only the first has none of its own), and the tokens apart."""
    text, apart = _LED_CLOSING.subn("", text)
    return _BETWEEN.split(text) if _ODD.search(text) else text.split(" "), apart


def cut_free(texts: pa.Array) -> pa.ListArray:
    """The pieces of each text; some may be empty."""
    ascii_only = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
    lower = pc.if_else(ascii_only, pc.ascii_lower(texts), texts)  # a special token is found before lower-casing
    parted = pc.replace_substring_regex(lower, r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])(\s)", r"\1 \2\3")
    return pc.split_pattern(pc.replace_substring(parted, "\n", " "), " ")


def blocks(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Runs of consecutive texts of about ``chars`` characters, or a single longer text."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


class _Memo(dict):
    """Values of known pieces; asking for another notes it and gives None."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def __missing__(self, piece: str) -> None:
        self.asked.add(piece)


class Encoder:
    """Encodes whole texts without added special tokens."""

    def __init__(self, path: str, cut: str) -> None:
        self.tokenizer, self.cut, self.memo = load(path), cut, _Memo()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536
        self.kind, self.code = np.dtype("<u4" if self.wide else "<u2"), "I" if self.wide else "H"
        plain = [
            (t.content, i)
            for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
            if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)
        ]
        self.mark, self.mark_id = plain[-1] if plain else (None, -1)
        self.letters = _byte_letters()
        # remembered pieces and their ids
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _pieces(self, pieces: list[str], lead: str, packed: bool) -> dict:
        """Each piece's packed ids or their count.

        Many pieces go to the library as one text, parted by a special token:
        it splits there before anything else.  Pieces that hold a mark's first
        two characters go alone.
        """
        apart = pieces if self.mark is None else [p for p in pieces if self.mark[:2] in p or self.mark[0] in p[-1:]]
        out = {p: self._pack(ids) if packed else len(ids) for p, ids in zip(apart, self._encode([lead + p for p in apart]), strict=True)}
        if self.mark is None:
            return out
        joined = [p for p in pieces if p not in out]
        groups = [joined[k : k + JOINED_PIECES] for k in range(0, len(joined), JOINED_PIECES)]
        texts = [self.mark.join([lead + p for p in g]) for g in groups]
        for group, ids in zip(groups, self._encode(texts), strict=True):
            row = np.array(ids, self.kind)
            stops = np.append(np.flatnonzero(row == self.mark_id), len(row))
            starts = np.append(0, stops[:-1] + 1)
            if packed:
                data, size = row.tobytes(), self.kind.itemsize
                cuts = zip((starts * size).tolist(), (stops * size).tolist(), strict=True)
                out.update((p, data[i:j]) for p, (i, j) in zip(group, cuts, strict=True))
            else:
                out.update(zip(group, (stops - starts).tolist(), strict=True))
        return out

    def _look_up(self, cuts: list[list[str]], lead: str, packed: bool) -> Iterator[list]:
        """The memo's value of every piece; new pieces are encoded, and remembered while there is room."""
        memo = self.memo
        known = memo.__getitem__
        found = [list(map(known, pieces)) for pieces in cuts]
        new, memo.asked = memo.asked, set()
        fresh = self._pieces(list(new), lead, packed)
        if len(memo) + len(fresh) <= MEMO_PIECES:
            memo.update((p, v) for p, v in fresh.items() if len(p) <= MEMO_CHARS)
        for pieces, vs in zip(cuts, found, strict=True):
            yield [fresh[p] if v is None else v for p, v in zip(pieces, vs, strict=True)] if None in vs else vs

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        for block in blocks(texts, LIST_CHARS):
            if self.cut != "led":
                yield from map(len, self._encode(block))
                continue
            cuts, apart = zip(*map(cut_led, block), strict=True)
            heads = self._encode([c[0] for c in cuts])
            values = self._look_up([c[1:] for c in cuts], " ", False)
            for head, rest, own in zip(heads, values, apart, strict=True):
                yield len(head) + sum(rest) + own

    def _merge_latin(self, piece: str) -> bytes:
        """The packed ids of a piece of Latin letters, by the merges alone."""
        piece = piece.lower()
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        latin = {p: self._merge_latin(p) for p in pieces if len(p) <= MEMO_CHARS and _LATIN.fullmatch(p)}
        return latin | self._pieces([p for p in pieces if p not in latin], "", True)

    def _remember(self, pieces: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(pieces), MEMO_CHARS)
        room = MEMO_IDS - len(self.known)
        self.known = pa.concat_arrays([self.known, pieces.filter(short).slice(0, room)])
        self.known_ids = pa.concat_arrays([self.known_ids, ids.filter(short).slice(0, room)])

    def _block_ids(self, texts: list[str]) -> tuple[memoryview, list[int]]:
        """The packed ids of all texts of a block, one after the other, and the bytes before each text's end."""
        cuts = cut_free(pa.array(texts, pa.large_string()))
        coded = cuts.flatten().dictionary_encode()
        slot = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(pc.is_null(slot))
        pieces = new.to_pylist()
        fresh = self._encode_new(pieces)
        fresh_ids = pa.array([fresh[p] for p in pieces], pa.large_binary())
        at = slot.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), -1, at).astype(np.int64) if slot.null_count else at.astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        found = pa.concat_arrays([self.known_ids, fresh_ids]).take(pa.array(at[coded.indices.to_numpy()]))
        if len(new) and len(self.known) < MEMO_IDS:
            self._remember(new, fresh_ids)
        place = np.frombuffer(found.buffers()[1], np.int64) if len(found) else np.zeros(1, np.int64)
        data = memoryview(found.buffers()[2]) if len(found) else memoryview(b"")
        return data, place[cuts.offsets.to_numpy()[1:]].tolist()

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian integers of ``kind``."""
        for block in blocks(texts, BLOCK_CHARS if self.cut == "free" else LIST_CHARS):
            if self.cut != "free":
                yield from map(self._pack, self._encode(block))
                continue
            data, ends = self._block_ids(block)
            yield from (bytes(data[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str | None = None) -> Encoder:
    """The encoder of this worker process; its memo lives as long as the worker."""
    cut = cut or cut_of(path)
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]

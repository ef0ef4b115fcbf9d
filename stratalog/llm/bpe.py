"""Exact BPE by backtracking, in time linear in a word's length (operator 9).

A sequence of tokens is the BPE encoding of a word exactly when each
neighbouring pair is *compatible*: encoding the two tokens' joint text gives
the pair back.  So it is enough to walk over the word taking the longest token
that starts at each place (one Aho-Corasick pass finds them all), to check it
against its left neighbour in the pair table, to fall back to the next shorter
token where the pair is not compatible, and to step back where none is left.
A place that failed once is never entered again, hence linear time.

Compatibility is decided from the merge tree.  A token is made of two others,
so the symbol next to a border changes over time along the token's *spine*:
the right spine of the left token and the left spine of the right one.  A pair
fails if a merge across the border exists between two spine members that are
both present when that merge's turn comes.

Tokenizer files are taken if they cut and normalise text in the one way that is
built in here (``NORMALIZER``, ``PRE_TOKENIZER``); others are refused, since
their ids would be wrong without a sign.  Special tokens come from the file.

Defined results: a null or empty text has no tokens, an empty table gives no
rows.  The strings of special tokens are matched in raw text before anything
else, as the library does.  Rows are independent, so repeated rows, ties and
further columns (which are kept out of the result) change nothing.  A very long
text is held whole, once as text and once as ids; pieces met lately are
remembered in bounded number.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from . import common

END = "</w>"
#: Added to the code point of a word's last symbol, which stands for symbol + END.
SHIFT = 0x10000


def _class(*categories: str) -> str:
    """Ranges of Unicode categories by Python's own tables, which are no newer than the library's; ``regex`` has newer ones."""
    out, first = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c)).startswith(categories)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


#: Fixed value: the pattern that cuts normalised text into pieces, with its letters (L), numbers (N) and spaces (S) spelled out.
PIECES = "[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^{S}{L}{N}]+"
#: Spaces of Latin-1; its letters after lower-casing; its numbers.
LATIN = {"L": "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "N": "0-9\xb2\xb3\xb9\xbc-\xbe", "S": "\t-\r \x85\xa0"}
LATIN_PIECES = re.compile(PIECES.format(**LATIN))


@functools.cache
def wide_patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """Pieces of any text, and code points newer than Python's tables."""
    return regex.compile(PIECES.format(L=_class("L"), N=_class("N"), S=r"\s")), regex.compile(f"[{_class('Cn')}]")


#: How the tokenizer files that are supported normalise and cut text, and their model's settings.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}


def supported(file: dict) -> list[str]:
    """The strings of a tokenizer file's special tokens; raises if the file works in another way than this module."""
    for part, expected in (("normalizer", NORMALIZER), ("pre_tokenizer", PRE_TOKENIZER), ("decoder", None)):
        if file.get(part) != expected:
            raise ValueError(f"a tokenizer with another {part} is not supported")
    for setting, expected in MODEL.items():
        if file["model"].get(setting, expected) != expected:
            raise ValueError(f"a model with another {setting} is not supported")
    if any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("special tokens that take more than their own string are not supported")
    return [t["content"] for t in file["added_tokens"]]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


SYMBOLS = byte_symbols()


class Vocabulary:
    """Tokens, merge tree, pair table and decoding table of one tokenizer file."""

    def __init__(self, path: str):
        self.path, self.library = path, []
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        names_of_special = supported(file)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.mark = os.path.commonprefix(names_of_special)  # what every text with a special token has
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in {**ids, **self.special}.items()}
        size = max(names) + 1
        # decoding table: all names in one buffer, and where each begins
        encoded = [names.get(i, "").encode() for i in range(size)]
        self.buffer = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at = [-1] * size
        self.parts: list[tuple[int, int] | None] = [None] * size
        for at, (left, right) in enumerate(merges):
            pair, whole = (ids[left], ids[right]), ids[left + right]
            if pair in self.rank or self.parts[whole] is not None:
                raise ValueError("a merge or its product is listed twice: the merge tree is not unique")
            if max(self.made_at[pair[0]], self.made_at[pair[1]]) >= at:
                raise ValueError("a merge comes before its parts are made")
            self.rank[pair], self.made_at[whole], self.parts[whole] = at, at, pair
        self.length = [0] * size
        self.shorter: list[int] = [-1] * size
        self.automaton = ahocorasick.Automaton()
        spelled: dict[str, int] = {}
        for name, i in ids.items():
            key = name[: -len(END) - 1] + chr(ord(name[-len(END) - 1]) + SHIFT) if name.endswith(END) and len(name) > len(END) else name
            spelled[key] = i
            self.length[i] = len(key)
            self.automaton.add_word(key, (i, len(key)))
        for key, i in spelled.items():
            self.shorter[i] = next((spelled[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in spelled), -1)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.never = len(merges)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(member, rank at which it is merged into the one above) from the token inwards."""
        out, until = [], self.never
        while True:
            out.append((token, until))
            if (parts := self.parts[token]) is None:
                return out
            until, token = self.made_at[token], parts[side]

    def compatible(self, left: int, right: int) -> bool:
        """Decides a pair and enters it in the table."""
        known, inner = True, self._spine(right, 0)
        for x, x_until in self._spine(left, 1):
            for y, y_until in inner:
                m = self.rank.get((x, y))
                # among equal ranks the leftmost merges first: the left side's own merge wins a tie, the right side's loses it
                if m is not None and m < x_until and m <= y_until:
                    known = False
        if len(self.pairs) >= 500_000:
            self.pairs.clear()
        self.pairs[left, right] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece of normalised text."""
        plain = piece.isascii() and piece.isalnum()  # then the stand-ins are the characters themselves
        return self.encode_symbols(piece if plain else "".join([SYMBOLS[b] for b in piece.encode()]))

    def encode_symbols(self, symbols: str) -> list[int]:
        word = symbols[:-1] + chr(ord(symbols[-1]) + SHIFT)
        n = len(word)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(word):
            longest[end - size + 1] = token  # ends ascend, so the longest comes last
        if self.length[longest[0]] == n:
            return [longest[0]]
        length, shorter, pairs = self.length, self.shorter, self.pairs
        out: list[int] = []
        dead: set[int] = set()
        at, token, before = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    fits = True if before < 0 else pairs.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                before, token = out[-1] if out else -1, shorter[token]
        return out

    def cut_by_library(self, text: str) -> list[str]:
        """Symbols of each piece of a text with code points newer than Python's Unicode tables; the library knows whether they are letters."""
        if not self.library:
            self.library.append(Tokenizer.from_file(self.path))
        t = self.library[0]
        return [piece for piece, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def decode(self, ids: np.ndarray) -> bytes:
        """Names of the tokens joined by a space, copied out of the buffer through the offset table."""
        if not len(ids):
            return b""
        begin, size = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        place = np.cumsum(size + 1)
        out = np.full(place[-1] - 1, 32, dtype=np.uint8)
        starts = place - size - 1
        shift = np.repeat(begin - starts, size)
        to = np.arange(len(shift)) + np.repeat(np.arange(len(ids)), size)
        out[to] = self.buffer[to + shift]
        return out.tobytes()


def pieces_of(text: str) -> list[str] | None:
    """Pieces of a text without special tokens, normalised; None if some of its code points are newer than Python's tables."""
    if in_latin_1(text):
        return LATIN_PIECES.findall(normalise(text))
    pieces, unknown = wide_patterns()
    return None if unknown.search(text) else pieces.findall(normalise(text))


class Encoder:
    """Texts to packed ids; pieces met lately are remembered."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 250_000):
        self.v = vocabulary
        self.pieces = common.Remembered(lambda piece: pack(self.v.encode_piece(piece)), limit)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        v, out = self.v, []
        for part in v.special_split.split(text) if v.special_split and v.mark in text else [text]:
            if part in v.special:
                out.append(pack([v.special[part]]))
            elif (pieces := pieces_of(part)) is not None:
                out += map(self.pieces.__getitem__, pieces)
            else:
                out += [pack(v.encode_symbols(x)) for x in v.cut_by_library(part)]
        return b"".join(out)


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if "\u03a3" in text:  # str.lower() would look at a sigma's neighbours
        return "".join(c.lower() for c in text)
    return text.lower()


def in_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` and n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids (array of int) and decoded."""
    common.ship(docs.sparkSession)
    slim = docs.select(*keep, docs[text].alias("__text"))
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            n, shas, decoded_shas, id_lists, texts = [], [], [], [], []
            for value in batch.column(len(keep)):
                packed = e.encode(value.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4")
                decoded = e.v.decode(ids)
                n.append(len(ids))
                shas.append(hashlib.sha256(packed).hexdigest())
                decoded_shas.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    id_lists.append(ids.astype(np.int32))
                    texts.append(decoded.decode())
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded_shas, pa.string())]
            if with_ids:
                columns += [pa.array(id_lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])

    return slim.mapInArrow(run, schema)

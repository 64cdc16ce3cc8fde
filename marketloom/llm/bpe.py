"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be
merged across, so the place between them is a token boundary in every text.
Where such a place is also certain to separate (or harmlessly divide) pieces
of the pre-tokeniser, a text is cut, every time: mostly at the end of each
word. The fragments are encoded independently and their ids concatenated, so
memory is bounded by the longest stretch without a certain cut, not by the
text. Runs of some 4 KB between cuts are encoded at once where the ranks alone
tell the ids; others are cut at every place, and a worker remembers a bounded
number of their short fragments.

Nulls count as empty texts, which have no ids. A text in which no certain cut
occurs is one fragment; so is every text if the vocabulary normalises texts or
has another pre-tokeniser. Rows, ties and repeats are independent of each
other, extra columns are kept, an existing column of the output's name is
replaced, and an empty table stays empty.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import raw_rows, small_batches, text_or_empty

#: Least length of a fragment, and how far one look for cuts reaches (both in bytes).
FRAGMENT, BLOCK = 1, 1 << 16
#: Least length of a run that is encoded at once.
RUN = 1 << 12
#: Fragments that a worker remembers, and bytes of the longest of them.
MEMO, MEMO_BYTES = 1 << 15, 64
#: The pieces that byte-level vocabularies of this family are split into first: a fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Finds characters from U+0180 on, whose classes regular expression engines may date differently.
BEYOND_LATIN = re.compile(rb"[\xc6-\xff]").search


def byte_alphabet() -> list[str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b if b in own else 256 + rest.index(b)) for b in range(256)]


def joined_pairs(tokens) -> np.ndarray:
    """bool[65536]: which pairs of bytes occur side by side inside a token."""
    seen = np.zeros(65536, bool)
    for token in tokens:
        raw = np.frombuffer(token, np.uint8).astype(np.uint16)
        seen[(raw[:-1] << 8) | raw[1:]] = True
    return seen


#: The last bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+180E, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000): fixed values.
SPACE_ENDS = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)


def certain_cuts(tokens) -> np.ndarray:
    """bool[65536]: pairs of bytes between which every text may be cut.

    Besides never occurring in a token, the pair must lie between characters,
    its left byte must not end white space (which looks ahead), and a fragment
    must not start a contraction by itself: two marks, or an apostrophe after a
    character beyond ASCII, stay together. Control characters that regular
    expression engines disagree about are left alone.
    """
    kind = np.zeros(256, np.uint8)
    for bytes_, k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"\t\n\x0b\x0c\r ", 3), (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 4), (range(0x80, 0xC0), 5), (range(0xC2, 0xF5), 6)):
        kind[list(bytes_)] = k
    ends = ((kind > 0) & (kind != 3) & (kind != 6))[:, None].copy()
    ends[list(SPACE_ENDS)] = False
    starts = ((kind > 0) & (kind != 5))[None, :]
    left, right = kind[:, None], kind[None, :]
    apostrophe = (np.arange(256) == ord("'"))[None, :]
    fits = ends & starts & ~((left == 4) & (right == 4)) & ~((left == 5) & apostrophe)
    return fits.ravel() & ~joined_pairs(tokens)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    with open(path) as file:
        spec = json.load(file)
    back = {c: b for b, c in enumerate(byte_alphabet())}
    ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


class Codec:
    """One vocabulary with its cut table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.token_bytes = token_bytes(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path) as file:
            spec = json.load(file)
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cut = certain_cuts([*self.token_bytes, *self.added]) if plain else np.zeros(65536, bool)
        self.ranked = self._ranked(spec) if plain else None
        self.known: dict[bytes, bytes] = {}

    def _ranked(self, spec: dict):
        """An encoder of the same pieces from ranks, if the ids of the vocabulary follow the order of its merges."""
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.token_bytes) if t and t not in self.added}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged) or len(ranks) + len(self.added) != len(self.token_bytes):
            return None
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _by_ranks(self, piece: bytes) -> bool:
        return self.ranked is not None and not BEYOND_LATIN(piece) and not any(t in piece for t in self.added)

    def _ids_of(self, fragment: bytes) -> bytes:
        if self._by_ranks(fragment):
            return array("i", self.ranked(fragment.decode())).tobytes()
        return array("i", self.tokenizer.encode(fragment.decode(), add_special_tokens=False).ids).tobytes()

    def fragments(self, raw: bytes, least: int | None = None):
        """Pieces of a text between certain cuts, ``least`` (``FRAGMENT``) bytes long or more but for the last."""
        codes, start, least = np.frombuffer(raw, np.uint8), 0, least or FRAGMENT
        for low in range(0, len(raw) - 1, BLOCK):
            part = codes[low : low + BLOCK + 1].astype(np.uint16)
            cuts = np.flatnonzero(self.cut[(part[:-1] << 8) | part[1:]]) + (low + 1)
            if least > 1:
                at, few = start, []
                while (i := int(cuts.searchsorted(at + least))) < len(cuts):
                    at = int(cuts[i])
                    few.append(at)
            else:
                few = cuts.tolist()
            for end in few:
                yield raw[start:end]
                start = end
        if start < len(raw):
            yield raw[start:]

    def encode(self, raw: bytes) -> bytes:
        """The ids of a UTF-8 text as little-endian 32-bit integers."""
        known, out = self.known, []
        for run in self.fragments(raw, RUN):
            if self._by_ranks(run):
                out.append(self._ids_of(run))
                continue
            for piece in self.fragments(run):
                ids = known.get(piece)
                if ids is None:
                    ids = self._ids_of(piece)
                    if len(piece) <= MEMO_BYTES:
                        if len(known) >= MEMO:
                            known.clear()
                        known[piece] = ids
                out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_ids(text, tokenizer_path: str):
    """Column of ``array<int>`` ids of a text column; null counts as empty."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        one = codec(tokenizer_path)
        flat, ends = bytearray(), [0]
        for raw in raw_rows(column):
            flat += one.encode(raw)
            ends.append(len(flat) // 4)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))

    return encode(text_or_empty(text))


def decode_ids(ids, tokenizer_path: str):
    """Column of the text that an ``array<int>`` column stands for.

    Bytes that are not UTF-8 come out as U+FFFD; a null array is an empty text.
    """

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        table = token_bytes(tokenizer_path)
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        return pa.array((b"".join([table[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])), pa.string())

    return decode(F.coalesce(F.col(ids) if isinstance(ids, str) else ids, F.array().cast("array<int>")))


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``; a map, without any shuffle."""
    small_batches(docs.sparkSession)
    return docs.withColumn(ids, encode_ids(text, tokenizer_path))


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``text`` that its ids stand for."""
    small_batches(encoded.sparkSession)
    return encoded.withColumn(text, decode_ids(ids, tokenizer_path))

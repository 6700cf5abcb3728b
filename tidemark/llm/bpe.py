"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so a cut between its two bytes is
certain. The text is first cut at the vocabulary's own special strings and by its pre-tokenising pattern, then each
piece at every such pair; fragments are encoded independently by the library's merge model and their ids concatenated.
Fragments and pieces repeat, so both are kept in bounded caches, and a very long run without white space falls into
short fragments.

The pattern engines can disagree only on characters newer than the oldest of their Unicode tables (compared over all
code points). Where a text holds a code point that Python's table calls unassigned, the library's own pre-tokeniser finds
its pieces; they are cut and encoded like all others.

Defined cases: null and empty texts give no tokens, and the digests of the empty string. Rows are independent: repeated
rows, null ids and further columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: The published byte-level pre-tokenising pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
LONG = 400


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Pieces(dict):
    """piece -> (ids joined by commas, number of ids, their bytes)"""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.codec.encode_piece(piece)
        out = ",".join(map(str, ids)), len(ids), b"".join(map(self.codec.token_bytes.__getitem__, ids))
        if len(piece) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder of one tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        spec = json.loads(self.whole.to_str())
        self.letters = byte_letters()
        self.back = back = {c: b for b, c in enumerate(self.letters)}
        self.token_bytes: dict[int, bytes] = {}
        inside = set()
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(back[c] for c in token)
            self.token_bytes[i] = raw
            inside.update(zip(raw, raw[1:]))
        self.special = {}
        for a in spec["added_tokens"]:
            if a["lstrip"] or a["rstrip"] or a["single_word"]:
                raise ValueError("special tokens that strip or match whole words are not supported")
            self.special[a["content"]] = a["id"]
            self.token_bytes[a["id"]] = a["content"].encode()
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.joins = bytearray(1 << 16)
        for a, b in inside:
            self.joins[a << 8 | b] = 1
        self.pieces = _Pieces(self)
        self.find = regex.compile(PATTERN).findall

    def fragments(self, raw: bytes) -> list[bytes]:
        """raw cut at every byte pair that lies inside no token."""
        joins, out, start = self.joins, [], 0
        for i in range(1, len(raw)):
            if not joins[raw[i - 1] << 8 | raw[i]]:
                out.append(raw[start:i])
                start = i
        out.append(raw[start:])
        return out

    def encode_piece(self, piece: str) -> list[int]:
        letters, tokenize = self.letters, self.model.tokenize
        return [t.id for f in self.fragments(piece.encode()) for t in tokenize("".join(map(letters.__getitem__, f)))]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        ids: list[int] = []
        for s in self.spans(text):
            if isinstance(s, int):
                ids.append(s)
            else:
                for p in s:
                    x = self.pieces[p][0]
                    ids += map(int, x.split(","))
        return ids

    def spans(self, text: str) -> Iterator[int | list[str]]:
        """Ids of special strings, and the pieces between them."""
        find = self._known if self._unassigned(text) else self.find
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield find(part)

    def _known(self, text: str) -> list[str]:
        """The pieces that the library's pre-tokeniser finds."""
        return [bytes(self.back[c] for c in piece).decode() for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    @staticmethod
    def _unassigned(text: str) -> bool:
        return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        text = text or ""
        said, size, raw, get = [], 0, [], self.pieces.__getitem__
        for s in self.spans(text):
            if isinstance(s, int):
                said.append(str(s))
                size += 1
                raw.append(self.token_bytes[s])
            else:
                got = list(map(get, s))
                said.append(",".join([x[0] for x in got]))
                size += sum([x[1] for x in got])
                raw += [x[2] for x in got]
        return size, _sha(",".join(said).encode()), _sha(b"".join(raw).decode("utf-8", "replace").encode())


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One Codec per file and worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. path: the vocabulary file, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = [c.digest(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f.type) for x, f in zip(cols, list(_OUT)[1:]))], schema=_OUT)

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [c.encode(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ids: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x.as_py() or []) for x in b.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

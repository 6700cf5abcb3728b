"""Fill-in-middle transformation: a document cut at two lines drawn from its id, and put together with the middle last.

A text is worked on as UTF-8 bytes, and all bytes at once: ``bytes.translate`` writes a class as ones and zeros, read as one
big integer whose bit i stands for byte i. Line ends are the bits of ``\\n`` and of the last byte; shifted by one they are the
starts. ``bit_count`` gives the number of lines and of code points; the end of the k-th line is the k-th set bit, found by
halving the integer and counting the lower half. Everything is linear in the text, without a Python step a byte or a line.

Lines are ``[^\\n]*\\n|[^\\n]+``. Cuts and forms come from the first four 32-bit groups of the SHA-256 of ``seed:doc_id``, so
they depend on nothing but the id and the number of lines. Documents that hold a marker stay plain: in all others the markers
of the output are the only ones, so ``restored`` splits at them.

Defined cases: null and empty texts are plain, with no lines. An id that is null counts as the empty string. Equal rows give
equal rows; other columns, whatever their names, change nothing. A text without a line end is one line; a long one takes an
integer of as many bits as it has bytes. Bytes that are no UTF-8 are kept; each that continues no character counts as one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50

_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_ENDS = bytes(0x31 if b == 0x0A else 0x30 for b in range(256))  # "1" for \n, "0" for others
_STARTS = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))  # "1" for bytes that begin a character
_WORD = 64


def class_mask(raw: bytes, ones: bytes) -> int:
    """The integer whose bit i is set if byte i of raw is in the class of the translation table."""
    return int(raw.translate(ones)[::-1], 2) if raw else 0


def line_ends(raw: bytes) -> int:
    """Bits of the bytes that end a line: those before a line's start, and the last byte."""
    if not raw:
        return 0
    starts = class_mask(raw, _ENDS) << 1 | 1
    return (starts >> 1) | 1 << (len(raw) - 1)


def ranked_bit(mask: int, k: int, width: int) -> int:
    """The place of the set bit with k set bits below it, by halving: half, a quarter, ... of the bits are counted."""
    at = 0
    while width > _WORD:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            mask, width = low, half
        else:
            mask, width, at, k = mask >> half, width - half, at + half, k - below
    for _ in range(k):
        mask &= mask - 1
    return at + (mask & -mask).bit_length() - 1


def place(ends: int, k: int, width: int) -> int:
    """How many bytes the first k lines take."""
    return ranked_bit(ends, k - 1, width) + 1 if k else 0


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four 32-bit numbers of an id."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def cut(raw: bytes, h: tuple[int, ...], rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points of the prefix, of the middle, output) of a text and its four numbers."""
    ends, size = line_ends(raw), len(raw)
    n = ends.bit_count()
    if not raw or h[2] % 100 >= rate or any(m in raw for m in _MARKS):
        return n, "plain", None, None, raw
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = place(ends, a, size), place(ends, b, size)
    chars = class_mask(raw, _STARTS) & ((1 << j) - 1)
    before = (chars & ((1 << i) - 1)).bit_count()
    prefix, suffix = _MARKS[0] + raw[:i], _MARKS[1] + raw[j:]
    form, first, second = ("spm", suffix, prefix) if h[3] % 100 < spm else ("psm", prefix, suffix)
    return n, form, before, chars.bit_count() - before, b"".join((first, second, _MARKS[2], raw[i:j]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output (text).

    rate of a hundred documents are transformed, spm of a hundred of those begin with the suffix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *cut(t.as_py() or b"", draws(i, seed), rate, spm)) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            cols = list(zip(*rows)) or [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")))
    out = src.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *k: F.concat(*(F.get(part, i) for i in k))
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with the SHA-256 of the output and of the text restored from it, in place of the output."""
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def _sql() -> str:
    draw = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT"
    join = lambda part: f"array_to_string({part}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS u FROM d),
x AS (SELECT *, len(u) AS n, t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {draw(2)} % 100 >= {RATE} AS plain,
  least({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1))::BIGINT AS a, greatest({draw(0)} % (len(u) + 1), {draw(1)} % (len(u) + 1))::BIGINT AS b, {draw(3)} % 100 < {SPM} AS spm FROM u),
p AS (SELECT doc_id, t, n, plain, spm, {join('u[1 : a]')} AS p, {join('u[a + 1 : b]')} AS m, {join('u[b + 1 :]')} AS s FROM x)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


SQL = _sql()

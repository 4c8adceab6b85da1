"""Media columns: signatures, format validators and carving.

One Aho-Corasick pass over a blob finds the magic bytes of all formats at once.
At each hit a validator walks the format's own structure and returns the length
it declares, or nothing. What is confirmed at offset 0 and fills the blob is its
type, whatever was declared; what is confirmed elsewhere is embedded media and
can be carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import blocks

#: Samples in a row of a stored picture; payloads are multiples of it.
ROW = 576
#: Bytes inflated at once.
PIECE = 1 << 16
PNG = b"\x89PNG\r\n\x1a\n"

# Magic bytes, where they stand from the start of the format, and the type.
SIGNATURES = [
    (PNG, 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS\x00", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"PK\x03\x04", 0, "application/zip"),
]


def png_length(b: bytes, at: int) -> tuple[str, int] | None:
    """Chunks from the header to IEND, each with its own checksum."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return "image/png", i - at
    return None


def gif_length(b: bytes, at: int) -> tuple[str, int] | None:
    def after_blocks(i: int) -> int:
        while b[i]:
            i += b[i] + 1
        return i + 1

    try:
        i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
        while b[i] != 0x3B:
            if b[i] == 0x21:
                i = after_blocks(i + 2)
            elif b[i] == 0x2C:
                i = after_blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0))
            else:
                return None
        return "image/gif", i + 1 - at
    except IndexError:
        return None


def jpeg_length(b: bytes, at: int) -> tuple[str, int] | None:
    """Segments by their lengths; after a scan header, to the next marker that isn't stuffing or a restart."""
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xFF:
            i += 1
            continue
        if kind == 0xD9:
            return "image/jpeg", i + 2 - at
        if not 0xC0 <= kind <= 0xFE:
            return None
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return ("image/jpeg", i + 2 - at) if b[i : i + 2] == b"\xff\xd9" else None


def bmp_length(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 26 > len(b):
        return None
    size, _, begin, header = struct.unpack_from("<IIII", b, at + 2)
    return ("image/bmp", size) if header in (12, 40, 52, 56, 108, 124) and 14 + header <= begin <= size <= len(b) - at else None


def riff_length(b: bytes, at: int) -> tuple[str, int] | None:
    """The size in the header must be met exactly by the chunks it holds."""
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind, end = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form), at + 8 + size
    i = at + 12
    while kind and i + 8 <= end <= len(b):
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
    return (kind, end - at) if kind and i == end <= len(b) else None


def gzip_length(b: bytes, at: int) -> tuple[str, int] | None:
    """To the end of the deflated data, of which a piece at a time is held however far it inflates."""
    inflate = zlib.decompressobj(31)
    try:
        left, i = b"", at
        while not inflate.eof:
            if not left:
                if i >= len(b):
                    return None
                left, i = b[i : i + PIECE], i + PIECE
            inflate.decompress(left, PIECE)
            left = inflate.unconsumed_tail
    except zlib.error:
        return None
    return "application/gzip", min(i, len(b)) - len(inflate.unused_data) - at


def ogg_length(b: bytes, at: int) -> tuple[str, int] | None:
    """Pages one after another."""
    i = at
    while b[i : i + 5] == b"OggS\x00" and i + 27 <= len(b):
        n = i + 27 + b[i + 26]
        i = n + sum(b[i + 27 : n])
        if i > len(b):
            return None
    return ("audio/ogg", i - at) if i > at else None


def mp4_length(b: bytes, at: int) -> tuple[str, int] | None:
    """Boxes while their types are known; one must hold the media."""
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"moof", b"mfra", b"uuid", b"meta", b"wide") or n < 8 or i + n > len(b):
            break
        kinds.add(kind)
        i += n
    return ("video/mp4", i - at) if kinds & {b"moov", b"mdat", b"moof"} else None


@lru_cache(1)
def zip_ends(b: bytes) -> dict[int, int]:
    """Where each end record whose directory is where it says has its archive begin, and the end of the first such archive: one
    pass for all places of a blob."""
    found: dict[int, int] = {}
    end = -1
    while (end := b.find(b"PK\x05\x06", end + 1)) >= 0 and end + 22 <= len(b):
        size, begin, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - begin - size
        if at >= 0 and b[at + begin : at + begin + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
            found.setdefault(at, end + 22 + note)
    return found


def zip_length(b: bytes, at: int) -> tuple[str, int] | None:
    end = zip_ends(b).get(at)
    return ("application/zip", end - at) if end else None


VALIDATORS: dict[str, Callable[[bytes, int], tuple[str, int] | None]] = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length, "riff": riff_length,
    "application/gzip": gzip_length, "audio/ogg": ogg_length, "video/mp4": mp4_length, "application/zip": zip_length,
}


@lru_cache(1)
def automaton():
    """Over Latin-1 text, in which a character is a byte."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, before, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), before, kind))
    found.make_automaton()
    return found


def sniff(blob: bytes) -> list[tuple[int, int, str]]:
    """Confirmed media in a blob as (offset, length, type), outermost only, by offset."""
    found, beyond = [], 0
    hits = sorted({(last + 1 - n - before, kind) for last, (n, before, kind) in automaton().iter(blob.decode("latin-1"))})
    for at, kind in hits:
        if at >= beyond and (known := VALIDATORS[kind](blob, at)):
            found.append((at, known[1], known[0]))
            beyond = at + known[1]
    return found


def corrected(declared: str | None, blob: bytes, found: list[tuple[int, int, str]]) -> str | None:
    """The type that the structure confirms for the whole blob, else the declared one."""
    return found[0][2] if found and found[0][:2] == (0, len(blob)) else declared


def scan(media: DataFrame, blob: str = "media", declared: str = "declared_type", key: str = "doc_id") -> DataFrame:
    """A row for each confirmed piece of each blob: key, declared_type, actual_type (of the whole blob), offset,
    length, type, carved (the bytes of an embedded piece; null where it is the whole blob). Blobs without one get a
    row with null offset. Null blobs count as empty. Rows are handled one by one, so repeated ones repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, blob):
            rows = []
            for k, b, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = sniff(b := b or b"")
                actual = corrected(d, b, found)
                rows += [(k, d, actual, at, n, kind, None if (at, n) == (0, len(b)) else b[at : at + n]) for at, n, kind in found] or [(k, d, actual, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["key", "declared_type", "actual_type", "offset", "length", "type", "carved"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, blob, declared).mapInArrow(run, f"key {kind}, declared_type string, actual_type string, offset long, length long, type string, carved binary").withColumnRenamed("key", key)


def as_png(payload: bytes) -> bytes:
    """8-bit grey samples, a row of ROW each, unfiltered."""
    high = len(payload) // ROW
    rows = np.zeros((high, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(high, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, high, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def png_samples(blob: bytes, at: int) -> bytes:
    """The samples of a picture as written by as_png, from its chunks."""
    i, data = at + 8, []
    while True:
        n, kind = struct.unpack_from(">I4s", blob, i)
        if kind == b"IHDR":
            wide, high = struct.unpack_from(">II", blob, i + 8)
        elif kind == b"IDAT":
            data.append(blob[i + 8 : i + 8 + n])
        elif kind == b"IEND":
            return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, wide + 1)[:, 1:].tobytes()
        i += 12 + n


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW if text else ROW)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(docs: DataFrame) -> DataFrame:
    """Each text as media and back: a picture is written with a wrong declared type, sniffed, corrected, and read
    back through its confirmed structure. feature: corrected type, piece found (offset, length), rows, and mean and
    spread of the samples.

    Null and empty texts give one row of 255s; equal texts equal values; nothing is shuffled. Only doc_id and text
    are read, and repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (text or "").encode()
                blob = as_png(padded(text))
                found = sniff(blob)
                kind = corrected("application/octet-stream", blob, found)
                back = png_samples(blob, found[0][0])
                samples = np.frombuffer(back, np.uint8)
                counts = np.bincount(samples, minlength=256)
                mean = int(counts @ np.arange(256)) / len(samples)
                spread = (int(counts @ np.arange(256) ** 2) / len(samples) - mean**2) ** 0.5
                feature = f"{kind} {found[0][0]}+{found[0][1]} {len(back) // ROW}x{ROW} mean={mean:.3f} sd={spread:.3f}"
                rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], [x.split()[0] for x in STORED.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, STORED)


def _size(n: str, hexed: str) -> str:
    """SQL of the eight hexadecimal digits of a size, lowest byte first."""
    return " || ".join(f"lpad({hexed.format(f'(({n}) // {1 << shift}) % 256')}, 2, '0')" for shift in (0, 8, 16, 24))


#: A header of 16 bytes for 8-bit samples, one channel, 8,000 a second: fixed values of the format.
_FORM = "666D74201000000001000100401F0000401F000001000800"


def _sound(text: str, n: str, hexed: str) -> str:
    """SQL of the hexadecimal digits of a sound whose samples are a text's bytes."""
    return f"'52494646' || {_size(f'36 + {n} + {n} % 2', hexed)} || '57415645{_FORM}64617461' || {_size(n, hexed)} || hex({text}) || CASE WHEN {n} % 2 = 1 THEN '00' ELSE '' END"


_BROKEN = "'52494646' || '07000000' || '57415645'"


def embedded(docs: DataFrame) -> DataFrame:
    """doc_id, media and declared_type of files that are made from texts: a sound between two copies of its text, a sound under a
    wrong type, or a text behind the header of a sound that isn't there. A null text counts as empty."""
    held = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') as text").selectExpr("*", "cast(octet_length(text) as long) as n", "coalesce(doc_id, 0) % 3 as form")
    sound = _sound("text", "n", "hex(cast({} as long))").replace("//", "div")
    blob = f"unhex(CASE form WHEN 0 THEN hex(text) || {sound} || hex(text) WHEN 1 THEN {sound} ELSE {_BROKEN} || hex(text) END)"
    return held.selectExpr("doc_id", f"{blob} as media", "CASE form WHEN 1 THEN 'image/png' ELSE 'text/plain' END as declared_type")


_SOUND = _sound("encode(text)", "n", "to_hex(CAST({} AS BIGINT))")
EMBEDDED_SQL = f"""
SELECT doc_id, CASE form WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS declared_type, CASE form WHEN 1 THEN 'audio/wav' ELSE 'text/plain' END AS actual_type, CASE form WHEN 0 THEN n WHEN 1 THEN 0 END AS "offset",
  CASE WHEN form < 2 THEN 44 + n + n % 2 END AS length, CASE WHEN form < 2 THEN 'audio/wav' END AS type, CASE form WHEN 0 THEN sha256(from_hex({_SOUND})) END AS carved_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, coalesce(doc_id, 0) % 3 AS form FROM documents)
"""

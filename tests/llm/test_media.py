import gzip
import hashlib
import io
import statistics
import struct
import time
import tracemalloc
import zipfile
import zlib

from rookery.llm import media

SCHEMA = "doc_id long, text string, media string, n_bytes int"
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04xx\x01\xff\x00\x02\xff\xd0\x03\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + bytes(40)
WAV = b"RIFF" + struct.pack("<I4s", 4 + 8 + 6, b"WAVE") + b"data" + struct.pack("<I", 6) + b"sample"
OGG = b"OggS\x00" + bytes(21) + b"\x01\x05" + b"12345"
MP4 = struct.pack(">I4s", 12, b"ftyp") + b"isom" + struct.pack(">I4s", 13, b"mdat") + b"media"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "text")
    return out.getvalue()


PIECES = {"image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "audio/wav": WAV, "audio/ogg": OGG, "video/mp4": MP4, "application/gzip": gzip.compress(b"x" * 99), "application/zip": zipped(), "image/png": media.as_png(bytes(range(192)) * 6)}


def test_structure_decides_over_declared_types_and_magic_bytes(spark):
    rows = [(i, b, "text/plain") for i, b in enumerate(PIECES.values())]
    rows += [(100 + i, b"before " + b + b" after", "text/html") for i, b in enumerate(PIECES.values())]
    rows += [(200 + i, b[:-3], kind) for i, (kind, b) in enumerate(PIECES.items())]
    rows += [(300, None, None), (301, b"", "x"), (302, b"BM GIF89a RIFF PK\x03\x04 ftyp \x89PNG", "text/plain"), (302, b"BM GIF89a RIFF PK\x03\x04 ftyp \x89PNG", "text/plain")]
    got = {}
    for r in media.scan(spark.createDataFrame(rows, "doc_id long, media binary, declared_type string").repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, (kind, b) in enumerate(PIECES.items()):
        [r] = got[i]
        assert (r["actual_type"], r["offset"], r["length"], r["carved"]) == (kind, 0, len(b), None)
        [r] = got[100 + i]
        assert (r["actual_type"], r["type"], r["offset"], r["carved"]) == ("text/html", kind, 7, b)
        assert all(r["offset"] is None or r["length"] < len(b) - 3 for r in got[200 + i]), kind
    assert [len(got[k]) for k in (300, 301, 302)] == [1, 1, 2] and all(r["offset"] is None for k in (300, 301, 302) for r in got[k])


def test_texts_come_back_from_their_pictures(spark):
    texts = ["", None, "é" * 288, "x" * 577, "<|png|>\x89PNG\r\n" * 500, "y" * 3_000_000]
    rows = [(i, t, "m", 1) for i, t in enumerate(texts)] + [(0, "", "m", 1), (None, "x" * 577, "m", 1)]
    held = media.stored(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert len(held) == len(rows)
    for r in held:
        text = ((texts[r["doc_id"]] if r["doc_id"] is not None else texts[3]) or "").encode()
        whole = text + b"\xff" * ((-len(text)) % 576 or (0 if text else 576))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert r["feature"].startswith(f"image/png 0+{r['media_bytes']} ")
    same = [tuple(r)[1:] for r in held if r["doc_id"] in (None, 3)]
    assert same[0] == same[1]
    assert media.stored(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bombs_and_many_magic_bytes():
    began = time.perf_counter()
    bomb = gzip.compress(bytes(300 << 20), 9)
    tracemalloc.start()
    assert media.sniff(b"x" + bomb + b"y") == [(1, len(bomb), "application/gzip")]
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert media.sniff(b"PK\x03\x04PK\x05\x06" * 40_000 + bytes(40)) == []
    assert time.perf_counter() - began < 30


def test_stored_form_and_feature_by_other_readers(spark):
    """The picture is read by a plain decoder of its own, and the feature's numbers come from the payload."""
    texts = ["some text " * 99, "é" * 5000, ""]
    for r in media.stored(spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], SCHEMA)).collect():
        payload = texts[r["doc_id"]].encode()
        payload += b"\xff" * (-len(payload) % 576 or (0 if payload else 576))
        rows = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        blob = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">II5B", 576, len(payload) // 576, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())
        mean, sd = statistics.fmean(payload), statistics.pstdev(payload)
        assert r["feature"] == f"image/png 0+{len(blob)} {len(payload) // 576}x576 mean={mean:.3f} sd={sd:.3f}"

import hashlib
import struct
import zlib

import numpy as np
import pytest
from docloom.llm.gif import decode, encode, gif_features, gif_frames, histogram, lzw_decode, lzw_encode, text_gifs
from docloom.llm.registry import queries


@pytest.mark.parametrize("n", [0, 1, 2, 255, 4096, 70_000])
@pytest.mark.parametrize("values", [1, 3, 256])
def test_lzw_round_trip(n, values):
    data = np.random.default_rng(n + values).integers(0, values, n).astype(np.uint8).tobytes()
    assert lzw_decode(lzw_encode(data), 8, n) == data


def test_payloads_come_back():
    for n in (64, 64 * 1024, 64 * 1025, 64 * 3000):
        payload = np.random.default_rng(n).integers(60, 90, n).astype(np.uint8).tobytes()
        frames = decode(encode(payload))
        assert b"".join(x.samples.tobytes() for x in frames) == payload
        assert len(frames) == -(-n // 65536) and all(x.delay_ms == 100 for x in frames)


def _codes(values: list[int], width: int) -> bytes:
    number = sum(v << (width * i) for i, v in enumerate(values))
    return number.to_bytes((len(values) * width + 7) // 8, "little")


def _frame(samples, disposal, transparent=None, left=0, top=0, w=2, h=1, interlaced=False):
    flags = disposal << 2 | (transparent is not None)
    stream = _codes([4, *[x for s in samples for x in (s, 4)][:-1], 5], 3)  # a clear code before each sample
    return struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, 7, transparent or 0, 0) + struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 * interlaced) + b"\x02" + bytes([len(stream)]) + stream + b"\0"


def _gif(*frames, w=2, h=1):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"".join(frames) + b";"


def test_disposal_and_transparency():
    red, green, blue, clear = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    frames = decode(_gif(_frame([1, 1], 1), _frame([2, 0], 2, transparent=0), _frame([3, 0], 3, transparent=0), _frame([0, 1], 0, transparent=0)))
    assert [x.canvas[0].tolist() for x in frames] == [[red, red], [green, red], [blue, clear], [clear, red]]
    assert [x.delay_ms for x in frames] == [70] * 4
    outside = decode(_gif(_frame([1, 2], 0, left=1)))
    assert outside[0].canvas[0].tolist() == [clear, red]
    rows = decode(_gif(_frame([0, 1, 2, 3], 0, w=1, h=4, interlaced=True), w=1, h=4))
    assert rows[0].samples[:, 0].tolist() == [0, 2, 1, 3]
    assert histogram(frames[0].canvas)[48] == 2 and histogram(frames[2].canvas).sum() == 1


def test_broken_files(spark):
    good = encode(bytes(range(64)))
    rows = spark.createDataFrame([(1, None, "a"), (2, b"", "a"), (3, b"GIF89a", "a"), (4, good[:-40], "a"), (5, good, "a"), (5, good, "a")], "doc_id long, media binary, _key string")
    out = gif_frames(rows).collect()
    assert [(r.doc_id, r.error) for r in out if r.error] == [(1, "not a GIF"), (2, "not a GIF"), (3, "not a GIF")]
    assert sorted(r.doc_id for r in out if not r.error) == [4, 5, 5]
    assert sum([r for r in out if r.doc_id == 5][0].histogram) == 64
    assert gif_frames(rows.limit(0)).count() == 0


def test_query(spark, sf, odd_docs):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    for r in queries()["op6_gif"](spark, sf).collect():
        raw = texts[r.doc_id].encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    odd = gif_features(text_gifs(odd_docs)).collect()
    assert len(odd) == 12 and [r.payload_bytes for r in odd if r.doc_id in (3, 4)] == [64, 64]
    assert len({r.feature for r in odd if r.doc_id in (1, 2)}) == 1


def test_files_without_a_frame_and_huge_canvases(spark):
    header = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0, 0, 0)
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    wide = _gif(_frame([1, 2], 0), _frame([1, 2], 0, w=65535, h=65535))
    rows = spark.createDataFrame([(1, header), (2, header + b";"), (3, huge), (4, wide), (None, _gif(_frame([1, 2], 0)))], "doc_id long, media binary")
    out = sorted(((r.doc_id, r.frame, r.error) for r in gif_frames(rows).collect()), key=str)
    assert out == sorted([(1, None, "no frame"), (2, None, "no frame"), (3, None, "too many pixels"), (4, 0, None), (4, None, "too many pixels"), (None, 0, None)], key=str)

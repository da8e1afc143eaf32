"""GIF columns: decode LZW code streams, apply palettes, disposal and transparency, store timed frames.

``gif_frames`` turns a binary column of GIF files into one row per timed frame with the composed picture
and a colour histogram. ``encode`` writes 8-bit samples losslessly as a GIF of 64-pixel rows, so that any
byte string can be kept as a picture and read back.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, stored, table

ROW = 64
#: Rows of a frame that ``encode`` writes; longer payloads become more frames.
FRAME_ROWS = 1024
#: Pixels of a canvas or frame that are decoded: 256 MB as RGBA.
MAX_PIXELS = 1 << 26
DELAY_CS = 10
_GREY = bytes(x for i in range(256) for x in (i, i, i))
_BASE = [bytes([i]) for i in range(256)]


@functools.lru_cache(1)
def _known() -> list[int]:
    """The string table of the encoder, all zero between calls."""
    return [0] * (4096 << 8)


@dataclass
class Frame:
    """One timed frame: its own samples and place, and the RGBA canvas after it is drawn."""

    left: int
    top: int
    samples: np.ndarray
    delay_ms: int
    canvas: np.ndarray


def _widths(start: int, n: int, least: int) -> np.ndarray:
    """Bits of the codes number ``start`` to ``start + n`` after a clear code, for ``least`` bits a sample."""
    free = np.arange(start, start + n, dtype=np.int64) + (1 << least) + 1
    width = np.searchsorted(np.int64(1) << np.arange(1, 13), free, side="right") + 1
    return np.clip(width, least + 1, 12)


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as a GIF code stream, with a clear code at the start and whenever the table is full."""
    codes = [256]
    clears = [0]
    emit = codes.append
    known = _known()  # code of a prefix and a byte after it; 0 for none
    keys: list[int] = []
    note = keys.append
    free = 258
    prefix = -1
    if data:
        prefix = data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            code = known[key]
            if code:
                prefix = code
                continue
            emit(prefix)
            known[key] = free
            note(key)
            free += 1
            prefix = byte
            if free == 4096:
                clears.append(len(codes))
                emit(256)
                for key in keys:
                    known[key] = 0
                keys.clear()
                free = 258
        emit(prefix)
    for key in keys:
        known[key] = 0
    emit(257)
    ends = clears[1:] + [len(codes) - 1]
    width = np.concatenate([[9], *[_widths(0, b - a, 8) for a, b in zip(clears, ends, strict=True)]])
    value = np.array(codes, np.int64)
    at = np.cumsum(width) - width
    value <<= at & 7
    byte_at = at >> 3
    n = int((at[-1] + width[-1] + 7) >> 3)
    out = np.zeros(n + 2)
    for i in range(3):
        out += np.bincount(byte_at + i, (value >> (8 * i)) & 255, minlength=n + 2)[: n + 2]
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, least: int, limit: int) -> bytes:
    """The samples of a GIF code stream, at most ``limit``; a stream that breaks off gives what it holds.

    Code widths follow from the number of codes since the last clear code, so codes are unpacked many at a
    time; only the growth of the string table goes code by code.
    """
    clear, stop = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits = 8 * len(stream)
    base = _BASE[:clear] + [b"", b""]
    strings, out, size = list(base), [], 0
    last = None
    bit = since = 0
    while bit < bits and size < limit:
        width = _widths(since, 4096, least)
        at = bit + np.cumsum(width) - width
        fit = int(np.searchsorted(at + width, bits, side="right"))
        if not fit:
            break
        at, width = at[:fit], width[:fit]
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(ends[0]) if len(ends) else fit
        run = codes[:n].tolist()
        if last is None and n:
            last = strings[run[0]] if run[0] < len(strings) else b""
            out.append(last)
            size += len(last)
            run = run[1:]
        done, room = len(out), 4096 - len(strings)
        grow, put = strings.append, out.append
        for code in run[:room]:
            try:
                text = strings[code]
            except IndexError:
                if code != len(strings):
                    return b"".join(out)[:limit]  # a broken stream
                text = last + last[:1]
            put(text)
            grow(last + text[:1])
            last = text
        for code in run[room:]:
            put(last := strings[code])
        size += sum(map(len, out[done:]))
        since += n
        bit = int(at[n - 1] + width[n - 1]) if n else bit
        if len(ends):
            bit += int(width[n])
            if codes[n] == stop:
                break
            strings, last, since = list(base), None, 0
    return b"".join(out)[:limit]


def encode(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as a grey GIF89a whose samples are its bytes."""
    rows = len(payload) // ROW
    parts = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for start in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - start)
        codes = lzw_encode(payload[start * ROW : (start + n) * ROW])
        parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, DELAY_CS, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, ROW, n, 0), b"\x08"]
        for i in range(0, len(codes), 255):
            block = codes[i : i + 255]
            parts += [bytes([len(block)]), block]
        parts.append(b"\0")
    return b"".join([*parts, b";"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The sub-blocks from ``at`` in one, and where they end."""
    found = []
    while at < len(data) and data[at]:
        found.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(found), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    raw = np.frombuffer(data[at : at + 3 * n], np.uint8)
    colours[: len(raw) // 3] = raw[: len(raw) // 3 * 3].reshape(-1, 3)
    return colours, at + 3 * n


def frames_of(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF87a or GIF89a file, one after another; ValueError if it isn't one or is larger than ``max_pixels``.

    A frame is drawn on the canvas that the frame before left by its disposal: as it was drawn (0, 1), with
    its rectangle cleared (2) or as it was before (3). Transparent samples and those outside the canvas
    leave the canvas as it is; missing samples count as 0. A file that breaks off gives the frames it holds. A canvas, or a
    frame, of more than ``max_pixels`` pixels is an error where it is met: sizes are declared and cost no bytes in the file.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    if width * height > max_pixels:
        raise ValueError("too many pixels")
    at = 13
    shared = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal = delay = 0
    transparent = -1
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else -1
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if w * h > max_pixels:
                raise ValueError("too many pixels")
            colours = shared
            if own & 0x80:
                colours, at = _palette(data, at, own)
            if at >= len(data) or not 1 <= data[at] <= 8:
                break
            least = data[at]
            stream, at = _blocks(data, at + 1)
            got = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
            samples = np.zeros(w * h, np.uint8)
            samples[: len(got)] = got
            samples = samples.reshape(h, w)
            if own & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples[order] = samples.copy()
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            seen = samples[: part.shape[0], : part.shape[1]]
            drawn = np.dstack((colours[seen], np.full(seen.shape, 255, np.uint8)))
            part[:] = np.where((seen == transparent)[..., None], part, drawn) if transparent >= 0 else drawn
            yield Frame(left, top, samples, 10 * delay, canvas.copy())
            if disposal == 2:
                part[:] = 0
            elif before is not None:
                canvas = before
            disposal, delay, transparent = 0, 0, -1
        else:  # the end, or bytes that are no block
            break


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> list[Frame]:
    """All frames of a file, see ``frames_of``."""
    return list(frames_of(data, max_pixels))


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by the two highest bits of red, green and blue: 64 counts."""
    seen = canvas.reshape(-1, 4)
    seen = seen[seen[:, 3] > 0] >> 6
    return np.bincount(seen[:, 0].astype(np.int64) * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


def gif_frames(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per frame: key, frame, delay_ms, width, height, rgba (the composed canvas), histogram, error.

    A null, empty or broken file, one without a frame and one of more than MAX_PIXELS pixels give a row with an error and
    no picture; frames before an error stay. Frames are decoded one by one. Other columns are left out; repeated keys stay apart
    only by their frames. An empty table gives an empty result.
    """

    def row(name, i=None, delay=None, width=None, height=None, rgba=None, counts=None, error=None) -> pd.DataFrame:
        return pd.DataFrame({"_key": [name], "frame": [i], "delay_ms": [delay], "width": [width], "height": [height], "rgba": [rgba], "histogram": [counts], "error": [error]})

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["_key"], batch["_media"], strict=True):
                i = 0
                try:
                    for x in frames_of(data or b""):
                        h, w = x.canvas.shape[:2]
                        yield row(name, i, x.delay_ms, w, h, x.canvas.tobytes(), histogram(x.canvas))
                        i += 1
                    if not i:
                        yield row(name, error="no frame")
                except ValueError as error:
                    yield row(name, error=str(error))

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("_key"), F.col(media).alias("_media"))
    out = rows.mapInPandas(frames, f"_key {kind}, frame int, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string")
    return out.withColumnRenamed("_key", key)


def text_gifs(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a GIF.

    A null text has no bytes, like an empty one, and is stored as 64 zeros. Repeated rows and rows without a doc_id all stay; equal texts
    have equal media; an empty table gives an empty result; other columns are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                raw = [(x or "").encode("utf-8", "surrogatepass") for x in part["text"]]
                media = [encode(x.ljust(max(ROW, -(-len(x) // ROW) * ROW), b"\0")) for x in raw]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in raw], "media": media})

    return documents(docs).mapInPandas(rows, "doc_id long, n_bytes long, media binary")


def gif_features(gifs: DataFrame) -> DataFrame:
    """Decodes stored GIFs (doc_id, n_bytes, media): digests of the samples read back, and a feature string.

    The feature has the number of frames, their time in ms and, for the pictures as composed, the counts of
    the 64 histogram bins that aren't empty. Frames are decoded one by one; a row of ``gifs`` gives a row, an empty table none. ``media`` that is
    null or no GIF is an error: ``text_gifs`` stores none.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, n_bytes, media in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
                parts, total, n, ms = [], np.zeros(64, np.int64), 0, 0
                for x in frames_of(media):
                    parts.append(x.samples.tobytes())
                    total, n, ms = total + histogram(x.canvas), n + 1, ms + x.delay_ms
                payload = b"".join(parts)
                bins = ",".join(f"{i}:{total[i]}" for i in np.flatnonzero(total).tolist())
                feature = f"frames={n};ms={ms};bins={bins}"
                out.append((name, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    return gifs.mapInPandas(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a GIF, read back from the stored table and decoded."""
    return gif_features(stored(text_gifs(table(spark, sf_dir, "documents")), "gifs"))

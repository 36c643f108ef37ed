"""Media columns: GIF images as timed frames with colour histograms.

``decode`` reads GIF87a/89a: logical screen, global and local palettes, graphic
control (delay, disposal, transparency), interlacing, sub-blocks and LZW code
streams with deferred clears. Frames are composited on the canvas as the
disposal rules say (0/1 keep, 2 clear the frame's area, 3 restore what was there);
transparent pixels leave the canvas as it is. ``encode`` writes the same format:
real LZW codes under a 256-entry palette, one frame per ``FRAME_BYTES`` samples.

``frames`` is the operator: a column of GIF bytes to one row per frame with its time, size, disposal, transparent index, RGB
pixels' digest and one histogram per channel. ``store_texts`` writes texts as images: a payload becomes 8-bit samples, 64 to a
row, under a palette of 256 different colours, in as many frames as it needs; what a further frame shares with the canvas is
left transparent, where a byte is free to say so. ``load_texts`` reads such a stored table back: payloads from the composited
canvas, and each image's timed frames with their histograms as a column.

Defined results: null or empty texts are 64 zero bytes; very long texts become several frames, streamed one at a time; damaged
bytes, and a canvas or frame of more than ``MAX_PIXELS``, raise ``GifError`` in ``decode`` before anything of that size is made
and give one row with ``error`` in ``frames``; a null image gives no row; repeated rows are handled each; ties don't arise; a
null doc_id stays null; empty tables give empty tables; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import map_texts, materialise

ROW = 64
FRAME_ROWS = 1024
FRAME_BYTES = ROW * FRAME_ROWS
DELAY_CS = 4
BINS = 8
MAX_PIXELS = 1 << 25
#: Sample v is red v; green and blue follow from it, so that the three histograms differ.
PALETTE = bytes(v for g in range(256) for v in (g, (5 * g + 17) % 256, 255 - g))


class GifError(ValueError):
    """The bytes are not a whole GIF."""


# --- LZW ---


def _widths(min_bits: int, n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear: the table gains an entry with each code but the first, up to 12 bits."""
    free = (1 << min_bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.minimum(12, np.maximum(min_bits + 1, np.floor(np.log2(free)).astype(np.int64) + 1))


_WIDTHS = {k: _widths(k, 8192) for k in range(1, 12)}
_FULL = 4096


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """Variable-width LZW codes, least significant bit first; the table is cleared when it is full."""
    clear = 1 << min_bits
    codes = [clear]
    put = codes.append
    table: dict[int, int] = {}
    get = table.get
    first = free = clear + 2
    if data:
        it = iter(data)
        have = next(it)
        for c in it:
            pair = have << 8 | c
            code = get(pair)
            if code is None:
                put(have)
                have = c
                if free < _FULL:
                    table[pair] = free
                    free += 1
                else:
                    put(clear)
                    table.clear()
                    free = first
            else:
                have = code
        put(have)
    put(clear + 1)
    # a clear is written at the width reached; the codes after it start over
    a = np.array(codes, np.int64)
    clears = np.flatnonzero(a == clear)
    since = np.arange(len(a)) - np.maximum.accumulate(np.where(a == clear, np.arange(len(a)), 0)) - 1
    since[clears[1:]] = clears[1:] - clears[:-1] - 1
    since[0] = 0
    return _pack(a, _WIDTHS[min_bits][since])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    end = np.cumsum(widths)
    bit = end - widths
    byte, value = bit >> 3, codes << (bit & 7)
    n = int(end[-1] + 7) // 8 + 3
    out = sum(np.bincount(byte + k, weights=value >> 8 * k & 255, minlength=n) for k in range(3))  # bits of codes never overlap: sums are unions
    return out.astype(np.uint8)[: n - 3].tobytes()


def lzw_decode(data: bytes, min_bits: int, size: int) -> bytes:
    """The first ``size`` samples of a code stream.

    Between two clears the widths of the codes are known beforehand, so they are cut out at once. The entry made
    after code i is its string and the sample that follows it in the output; a code for that entry is thus a copy
    of earlier output, one sample longer than code i's. Copies are followed back to literals by doubling.
    """
    if min_bits not in _WIDTHS:
        raise GifError(f"LZW code size {min_bits}")
    clear = 1 << min_bits
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at, got = 8 * len(data), 0, 0
    out: list[bytes] = []
    while got < size:
        codes, ended, step, done = [], False, 256, 0
        start = at
        while not ended:  # codes up to the next clear or stop, in growing steps
            widths = _WIDTHS[min_bits][done : done + step] if done + step <= 8192 else np.full(step, 12)
            bit = at + np.cumsum(widths) - widths
            keep = bit + widths <= bits
            widths, bit = widths[keep], bit[keep]
            if not len(bit):
                break
            byte = bit >> 3
            c = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (bit & 7) & ((1 << widths) - 1)
            marks = np.flatnonzero((c == clear) | (c == clear + 1))
            if len(marks):
                k = int(marks[0])
                ended, stop = True, c[k] == clear + 1
                at = int(bit[k] + widths[k])
                c = c[:k]
            else:
                at = int(bit[-1] + widths[-1])
            codes.append(c)
            done += len(c)
            step = min(2 * step, 4096)
        c = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        if len(c):
            out.append(_strings(c, clear))
            got += len(out[-1])
        if at == start or not ended or stop:
            break
    if got < size:
        raise GifError(f"{got} of {size} samples")
    return b"".join(out)[:size]


def _strings(codes: np.ndarray, clear: int) -> bytes:
    """The samples of the codes between two clears."""
    place = np.arange(len(codes))
    up = codes - (clear + 2)
    literal = up < 0
    if (up >= np.minimum(place, _FULL - clear - 2)).any():
        raise GifError("a code beyond the table")
    up = np.where(literal, place, up)
    length, above = (~literal).astype(np.int64), up
    while not literal[above].all():
        length = length + length[above]
        above = above[above]
    length = length + 1
    begin = np.cumsum(length) - length
    total = int(begin[-1] + length[-1])
    shift = np.where(literal, 0, begin[up] - begin)
    source = (np.arange(total) + np.repeat(shift, length)).astype(np.int32)
    while not np.array_equal(further := source[source], source):
        source = further
    samples = np.zeros(total, np.uint8)
    samples[begin[literal]] = codes[literal]
    return samples[source].tobytes()


# --- the container ---


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: np.ndarray
    rgb: np.ndarray


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[k : k + 255]),)) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode(samples: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, palette: bytes = PALETTE, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF of ``samples``, ``row`` to a line, cut into frames of ``frame_rows`` lines; the last may be lower than the canvas.

    Frames stay (disposal 1). In a further frame without the sample 255 that index is transparent and stands for what the
    canvas has already.
    """
    if not samples or len(samples) % row:
        raise GifError(f"{len(samples)} samples don't fill rows of {row}")
    lines = len(samples) // row
    out = [b"GIF89a", struct.pack("<HHBBB", row, min(lines, frame_rows), 0xF7, 0, 0), palette]
    if lines > frame_rows:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    canvas = np.frombuffer(samples[: frame_rows * row], np.uint8).copy()
    for at in range(0, lines, frame_rows):
        part, clear = samples[at * row : (at + frame_rows) * row], 0
        if at and b"\xff" not in part:
            new, have = np.frombuffer(part, np.uint8), canvas[: len(part)]
            part, clear = np.where(new == have, np.uint8(255), new).tobytes(), 1
            canvas[: len(new)] = new
        elif at:
            canvas[: len(part)] = np.frombuffer(part, np.uint8)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2 | clear, delay_cs, 255 if clear else 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, row, len(part) // row, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _lace(height: int) -> np.ndarray:
    """The lines of an interlaced image in the order they are stored."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order, each with its own samples and the canvas after it was drawn, before its disposal."""
    try:
        yield from _decode(data)
    except (IndexError, struct.error) as e:
        raise GifError("cut short") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MAX_PIXELS:
        raise GifError(f"a canvas of {width} x {height}")
    at = 13
    palette = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 3), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 1)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise GifError(f"block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        if w * h > MAX_PIXELS:
            raise GifError(f"a frame of {w} x {h}")
        colours = palette
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colours = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
            at += n
        if colours is None:
            raise GifError("no palette")
        bits = data[at]
        at += 1
        parts = []
        while size := data[at]:
            parts.append(data[at + 1 : at + 1 + size])
            at += size + 1
        at += 1
        samples = np.frombuffer(lzw_decode(b"".join(parts), bits, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            order, straight = _lace(h), np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        if int(seen.max(initial=0)) >= len(colours):
            colours = np.vstack([colours, np.zeros((256 - len(colours), 3), np.uint8)])
        drawn = colours[seen]
        if clear_index is None:
            area[:] = drawn
        else:
            solid = seen != clear_index
            area[solid] = drawn[solid]
        yield Frame(left, top, w, h, delay, disposal, clear_index, samples, canvas.copy())
        if disposal == 2:
            area[:] = palette[back] if palette is not None and clear_index is None and back < len(palette) else 0
        elif disposal == 3:
            canvas[:] = before
        delay, disposal, clear_index = 0, 0, None


def histogram(rgb: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of ``bins`` equal ranges of each channel: (3, bins) for red, green, blue."""
    level = rgb.reshape(-1, 3)
    return np.stack([np.bincount(level[:, c], minlength=256).reshape(bins, -1).sum(1) for c in range(3)])


FRAMES = "frame int, at_cs long, delay_cs int, left int, top int, width int, height int, disposal int, transparent int, rgb_sha256 string, red array<long>, green array<long>, blue array<long>, error string"


def frames(images: DataFrame, image: str = "image", row_id: str = "row_id") -> DataFrame:
    """row_id and ``FRAMES``, one row per frame of each image; a damaged image gives the frames before the damage and one row with ``error``."""
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def start():
        def of(images: list[bytes | None], _):
            out = []
            for data in images:
                rows, at, n = [], 0, 0
                try:
                    for f in decode(data) if data is not None else ():
                        red, green, blue = histogram(f.rgb).tolist()
                        rows.append(dict(zip(names, (n, at, f.delay_cs, f.left, f.top, f.width, f.height, f.disposal, f.transparent, hashlib.sha256(f.rgb.tobytes()).hexdigest(), red, green, blue, None), strict=True)))
                        at, n = at + f.delay_cs, n + 1
                except GifError as e:
                    rows.append(dict.fromkeys(names) | {"frame": n, "at_cs": at, "error": str(e)})
                out.append(rows)
            return {"frames": out}

        return of

    kind = ", ".join(":".join(c.split(" ", 1)) for c in FRAMES.split(", "))
    found = map_texts(images.select(F.col(row_id).cast("long").alias("row_id"), F.col(image).alias("image")), f"frames array<struct<{kind}>>", start, text="image")
    return found.select("row_id", F.explode("frames").alias("f")).select("row_id", "f.*")


# --- texts as images ---


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b"\0")


TIMED = "array<struct<frame:int,at_cs:long,delay_cs:int,disposal:int,transparent:int,red:array<long>,green:array<long>,blue:array<long>>>"


def load_payload(image: bytes) -> tuple[bytes, list[dict]]:
    """The payload and the timed frames with their histograms, from stored bytes alone."""
    parts, timed, at = [], [], 0
    for n, f in enumerate(decode(image)):
        shown = f.rgb[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append(np.ascontiguousarray(shown[..., 0]).tobytes())
        red, green, blue = histogram(shown).tolist()
        timed.append({"frame": n, "at_cs": at, "delay_cs": f.delay_cs, "disposal": f.disposal, "transparent": f.transparent, "red": red, "green": green, "blue": blue})
        at += f.delay_cs
    return b"".join(parts), timed


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, image): each text as a GIF."""

    def start():
        def of(texts: list[str | None], _):
            made = [payload_of(t) for t in texts]
            return {"n_bytes": [n for n, _ in made], "image": [encode(p) for _, p in made]}

        return of

    return map_texts(docs.select("doc_id", "text"), "n_bytes long, image binary", start)


def load_texts(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but image, what its stored bytes hold and a feature string of the histograms; ``frames`` in the shape ``TIMED``."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames")

    def start():
        def of(images: list[bytes], _):
            rows = []
            for image in images:
                back, timed = load_payload(image)
                sums = {c: np.sum([f[c] for f in timed], axis=0).tolist() for c in ("red", "green", "blue")}
                feature = ";".join([f"frames={len(timed)}", *(f"{c}={','.join(map(str, n))}" for c, n in sums.items())])
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(image), hashlib.sha256(image).hexdigest(), feature, timed))
            return {n: [r[k] for r in rows] for k, n in enumerate(names)}

        return of

    kinds = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {TIMED}"
    return map_texts(media, kinds, start, text="image")


def op1_gif_media(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return load_texts(materialise(store_texts(docs)))

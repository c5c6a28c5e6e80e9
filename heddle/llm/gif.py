"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

``decode`` reads any GIF87a/89a file: it decodes the LZW streams, applies local and global palettes,
composes frames under their disposal and transparency rules and keeps their delays. ``encode`` stores
8-bit samples as frames of palette indices; ``frames_table`` and ``payload_table`` are the Spark forms.

Defined results
---------------
* null or empty text: a payload of 64 zero bytes. Very long texts: several frames, since a frame has
  at most 65,535 rows; nothing is cut.
* null or malformed media in ``frames_table``: one row with frame null and the reason in ``error``; so is
  well-formed media without images. A null media_id is carried as it is.
* repeated rows: one result row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import byte_chunks, documents

WIDTH = 64
MAX_ROWS = 65_535
CLEAR, END = 256, 257


# --- LZW -----------------------------------------------------------------------------------------


def _widths(n: int, root: int) -> np.ndarray:
    """Bits of the codes 0..n-1 after a clear code: a reader has max(0, i - 1) entries of its own at code i."""
    free = (1 << root) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, root + 1, 12)


WIDTHS_8 = _widths(4200, 8)


def lzw_encode(samples: bytes) -> bytes:
    """The LZW code stream of 8-bit samples (root size 8), least significant bit first."""
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free = END + 1
    get = table.get
    it = iter(samples)
    w = next(it, -1)
    for b in it:
        k = w << 8 | b
        c = get(k)
        if c is not None:
            w = c
            continue
        codes.append(w)
        w = b
        if free < 4096:
            table[k] = free
            free += 1
        else:
            runs.append(codes)
            codes = []
            table.clear()
            free = END + 1
    if w >= 0:
        codes.append(w)
    runs.append(codes)
    all_codes, widths = [np.array([CLEAR])], [np.array([9])]
    for i, run in enumerate(runs):
        last = i + 1 == len(runs)
        all_codes += [np.array(run, np.int64), np.array([END if last else CLEAR])]
        widths.append(WIDTHS_8[: len(run) + 1])
    code, width = np.concatenate(all_codes).astype(np.int64), np.concatenate(widths)
    bits = (code[:, None] >> np.arange(12)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_decode(stream: bytes, root: int) -> bytes:
    """Samples of an LZW code stream with the given root size; ends at the end code or with the stream."""
    clear, end = 1 << root, (1 << root) + 1
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, out = roots.copy(), []
    put, add = out.append, table.append
    width, limit, bits, have = root + 1, 1 << (root + 1), 0, 0
    last = None
    pos = 0
    while True:
        if have < width:
            chunk = stream[pos : pos + 6]
            if not chunk:
                break
            bits |= int.from_bytes(chunk, "little") << have
            pos += 6
            have += 8 * len(chunk)
            if have < width:
                break
        code = bits & (limit - 1)
        bits >>= width
        have -= width
        if code == clear:
            table = roots.copy()
            add = table.append
            width, limit, last = root + 1, 1 << (root + 1), None
            continue
        if code == end:
            break
        size = len(table)
        if last is None:
            if code >= size:
                raise ValueError("LZW: first code is not a root")
            word = table[code]
        else:
            if code < size:
                word = table[code]
            elif code == size:
                word = last + last[:1]
            else:
                raise ValueError("LZW: code out of range")
            if size < 4096:
                add(last + word[:1])
                if size + 1 == limit and width < 12:
                    width += 1
                    limit <<= 1
        put(word)
        last = word
    return b"".join(out)


# --- the container ---------------------------------------------------------------------------------


@dataclass
class Frame:
    """One frame: its raw samples and the RGBA canvas once it is drawn."""

    delay_cs: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    samples: bytes
    pixels: np.ndarray = field(repr=False)


def _blocks(data: bytes, pos: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[pos]
        pos += 1
        if not n:
            return b"".join(parts), pos
        parts.append(data[pos : pos + n])
        pos += n


def images(data: bytes) -> Iterator[dict]:
    """The images of a GIF in order, with their control data; raises ValueError where it is malformed."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        w, h, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
        pos, shared = 13, None
        if flags & 0x80:
            shared, pos = _palette(data, pos, flags)
        control = {"delay_cs": 0, "disposal": 0, "clear_index": None}
        while True:
            kind = data[pos]
            pos += 1
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[pos]
                body, pos = _blocks(data, pos + 1)
                if label == 0xF9:
                    bits, delay, index = struct.unpack_from("<BHB", body)
                    control = {
                        "delay_cs": delay,
                        "disposal": bits >> 2 & 7,
                        "clear_index": index if bits & 1 else None,
                    }
            elif kind == 0x2C:
                left, top, fw, fh, bits = struct.unpack_from("<HHHHB", data, pos)
                pos += 9
                palette = shared
                if bits & 0x80:
                    palette, pos = _palette(data, pos, bits)
                root = data[pos]
                body, pos = _blocks(data, pos + 1)
                samples = lzw_decode(body, root)[: fw * fh]
                yield control | {
                    "screen": (w, h),
                    "background": back,
                    "palette": palette,
                    "box": (left, top, fw, fh),
                    "interlaced": bool(bits & 0x40),
                    "samples": samples,
                }
                control = {"delay_cs": 0, "disposal": 0, "clear_index": None}
            else:
                raise ValueError(f"unknown block {kind:#x}")
    except (IndexError, struct.error) as e:
        raise ValueError("truncated GIF") from e


def _palette(data: bytes, pos: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if pos + 3 * n > len(data):
        raise ValueError("truncated palette")
    return np.frombuffer(data, np.uint8, 3 * n, pos).reshape(n, 3), pos + 3 * n


def _row_order(rows: int) -> np.ndarray:
    """The rows of an interlaced image in the order in which they are stored."""
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def draw(data: bytes) -> Iterator[Frame]:
    """The frames one by one, composed on the canvas under disposal and transparency."""
    canvas = None
    for im in images(data):
        (w, h), (x, y, fw, fh) = im["screen"], im["box"]
        if canvas is None:
            canvas = np.zeros((h, w, 4), np.uint8)
        before = canvas.copy() if im["disposal"] == 3 else None
        index = np.zeros(fw * fh, np.uint8)
        got = np.frombuffer(im["samples"], np.uint8)
        index[: len(got)] = got
        drawn = np.arange(fw * fh) < len(got)
        index, drawn = index.reshape(fh, fw), drawn.reshape(fh, fw)
        if im["interlaced"]:
            order = _row_order(fh)
            straight, known = np.empty_like(index), np.empty_like(drawn)
            straight[order], known[order] = index, drawn
            index, drawn = straight, known
        if im["palette"] is None:
            raise ValueError("no palette")
        if im["clear_index"] is not None:
            drawn = drawn & (index != im["clear_index"])
        solid = np.concatenate([im["palette"], np.full((len(im["palette"]), 1), 255, np.uint8)], axis=1)
        view = canvas[y : y + fh, x : x + fw]
        index, drawn = index[: view.shape[0], : view.shape[1]], drawn[: view.shape[0], : view.shape[1]]
        colours = solid[np.minimum(index, len(solid) - 1)]
        view[...] = colours if drawn.all() else np.where(drawn[..., None], colours, view)
        yield Frame(im["delay_cs"], im["disposal"], x, y, fw, fh, im["samples"], canvas.copy())
        if im["disposal"] == 2:
            view[:] = 0
        elif before is not None:
            canvas = before


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF; ValueError where it is malformed."""
    return list(draw(data))


# A grey palette of 256 steps, so that a sample's value is its shade.
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode(payload: bytes, delay_cs: int = 10) -> bytes:
    """A GIF whose frames' samples are the payload (a multiple of WIDTH bytes), in order."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), GREY]
    for at in range(0, rows, MAX_ROWS):
        n = min(MAX_ROWS, rows - at)
        code = lzw_encode(payload[at * WIDTH : (at + n) * WIDTH])
        parts += [
            b"\x21\xf9\x04",
            struct.pack("<BHB", 1 << 2, delay_cs, 0),
            b"\x00\x2c",
            struct.pack("<HHHHB", 0, 0, WIDTH, n, 0),
            b"\x08",
            *(bytes([len(b)]) + b for b in (code[i : i + 255] for i in range(0, len(code), 255))),
            b"\x00",
        ]
    return b"".join([*parts, b"\x3b"])


def read_payload(media: bytes) -> bytes:
    """The samples of all frames, in order."""
    return b"".join(im["samples"] for im in images(media))


def cells(pixels: np.ndarray, levels: int) -> np.ndarray:
    """Counts of the visible pixels by colour cell (levels per channel, red slowest)."""
    seen = pixels.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    step = (np.arange(256) * levels // 256).astype(np.int32)
    cell = (step[seen[:, 0]] * levels + step[seen[:, 1]]) * levels + step[seen[:, 2]]
    return np.bincount(cell, minlength=levels**3)


def histogram(pixels: np.ndarray, levels: int = 4) -> list[float]:
    """Shares of the visible pixels by colour cell; zeros if none shows."""
    counts = cells(pixels, levels)
    return (counts / max(1, counts.sum())).tolist()


def timed(frames: Iterable[Frame]) -> Iterator[tuple[int, Frame]]:
    """Each frame with the time at which it is shown, in hundredths of a second."""
    start = 0
    for f in frames:
        yield start, f
        start += f.delay_cs


# --- Spark forms -----------------------------------------------------------------------------------

FRAMES = (
    "media_id long, frame int, start_cs long, delay_cs int, disposal int, width int, height int, "
    "visible_share double, histogram array<double>, error string"
)


def frames_table(media: DataFrame) -> DataFrame:
    """Timed frames of a table (media_id, media binary): composed size, start time and colour histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch["media_id"].to_pylist(), batch["media"].to_pylist(), strict=True):
                try:
                    frames, error = decode(data or b""), "no images"
                except ValueError as e:
                    frames, error = [], str(e)
                if not frames:
                    rows.append((key, *[None] * 8, error))
                for i, (start, f) in enumerate(timed(frames)):
                    h, w = f.pixels.shape[:2]
                    shown = float((f.pixels[..., 3] > 0).mean()) if h * w else 0.0
                    rows.append((key, i, start, f.delay_cs, f.disposal, w, h, shown, histogram(f.pixels), None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, FRAME_TYPES, strict=True)], [x.split()[0] for x in NAMES]
            )

    return media.selectExpr("cast(media_id as long) media_id", "cast(media as binary) media").mapInArrow(run, FRAMES)


NAMES = [x.strip() for x in FRAMES.split(",")]
FRAME_TYPES = [
    pa.int64(),
    pa.int32(),
    pa.int64(),
    *[pa.int32()] * 4,
    pa.float64(),
    pa.list_(pa.float64()),
    pa.string(),
]


def _media(batches: Iterator[pa.RecordBatch], limit: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    for whole in batches:
        for batch in byte_chunks(whole, "text", limit):
            found = []
            for text in batch["text"]:
                raw = text.as_py().encode()
                found.append((len(raw), encode(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))))
            yield batch, found


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _media(batches):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found])],
                ["doc_id", "n_bytes", "media"],
            )

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, frames int"
)


def payload_table(docs: DataFrame) -> DataFrame:
    """Digests of each text's stored GIF and of the payload read back from its decoded frames, with their colours.

    The stored bytes go through ``decode``: each frame is drawn under its palette, transparency and disposal. feature:
    the timed frames, joined by ";", each as its start time and the counts of its visible pixels by colour cell
    (16 levels per channel, empty cells left out), such as "0:819=12,1092=52".
    """

    def frame_feature(start: int, frame: Frame) -> str:
        count = cells(frame.pixels, 16)
        return f"{start}:" + ",".join(f"{c}={count[c]}" for c in np.flatnonzero(count).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
        for batch, found in _media(batches):
            rows = []
            for doc, (n, media) in zip(batch["doc_id"].to_pylist(), found, strict=True):
                samples, features = [], []
                for start, f in timed(draw(media)):  # one frame at a time
                    samples.append(f.samples)
                    features.append(frame_feature(start, f))
                back = b"".join(samples)
                rows.append(
                    (
                        doc,
                        n,
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-64:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        ";".join(features),
                        len(features),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
            )

    return documents(docs).mapInArrow(run, DIGEST)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query."""
    return payload_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))

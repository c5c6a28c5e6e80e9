"""Hand-made GIFs: palettes, disposal, transparency, interlace, timing and malformed media."""

import struct

import numpy as np
import pytest

from heddle.llm import gif

RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)


def table(colours):
    return b"".join(bytes(c) for c in colours)


def lzw(samples, root=2):
    """A plain stream: a clear code before every sample keeps all codes at their first width."""
    codes = [c for s in samples for c in (1 << root, s)] + [(1 << root) + 1]
    bits = "".join(format(c, f"0{root + 1}b")[::-1] for c in codes)
    body = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    return bytes([root, *([len(body)] if body else [])]) + body + b"\0"


def image(box, samples, local=None, interlaced=False):
    flags = (0x80 | 1 if local else 0) | (0x40 if interlaced else 0)
    return b"\x2c" + struct.pack("<HHHHB", *box, flags) + (table(local) if local else b"") + lzw(samples)


def control(disposal=0, delay=0, clear=None):
    return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"


def movie(w, h, *parts, shared=(RED, GREEN, BLUE, WHITE)):
    head = struct.pack("<HHBBB", w, h, 0x80 | 1 if shared else 0, 0, 0)
    return b"GIF89a" + head + (table(shared) if shared else b"") + b"".join(parts) + b"\x3b"


def seen(frame):
    """Rows of colours; None where nothing is drawn."""
    return [[tuple(map(int, p[:3])) if p[3] else None for p in row] for row in frame.pixels]


def test_disposal_to_background_and_to_previous():
    full, dot = (0, 0, 2, 1), (1, 0, 1, 1)
    frames = gif.decode(movie(2, 1, control(1), image(full, [0, 0]), control(3), image(dot, [1]), control(2), image(dot, [2]), control(0), image((0, 0, 1, 1), [3])))
    assert [seen(f) for f in frames] == [[[RED, RED]], [[RED, GREEN]], [[RED, BLUE]], [[WHITE, None]]]


def test_transparent_pixels_keep_what_is_below():
    frames = gif.decode(movie(3, 1, image((0, 0, 3, 1), [0, 0, 0]), control(1, clear=2), image((0, 0, 3, 1), [2, 1, 2])))
    assert seen(frames[1]) == [[RED, GREEN, RED]]
    alone = gif.decode(movie(2, 1, control(0, clear=0), image((0, 0, 2, 1), [0, 1])))
    assert seen(alone[0]) == [[None, GREEN]] and gif.cells(alone[0].pixels, 2).sum() == 1


def test_local_palettes_and_frames_beyond_the_canvas():
    own = ((1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12))
    frames = gif.decode(movie(2, 1, image((0, 0, 2, 1), [3, 0], local=own), image((1, 0, 2, 1), [1, 2])))
    assert seen(frames[0]) == [[(10, 11, 12), (1, 2, 3)]] and seen(frames[1]) == [[(10, 11, 12), GREEN]]
    with pytest.raises(ValueError, match="palette"):
        gif.decode(movie(1, 1, image((0, 0, 1, 1), [0]), shared=None))


def test_interlaced_rows():
    stored = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    frames = gif.decode(movie(1, 9, image((0, 0, 1, 9), [r % 4 for r in stored], interlaced=True)))
    assert [row[0] for row in seen(frames[0])] == [(RED, GREEN, BLUE, WHITE)[r % 4] for r in range(9)]


def test_frames_table(spark):
    good = movie(2, 1, control(1, 5), image((0, 0, 2, 1), [0, 1]), control(1, 7, clear=0), image((0, 0, 2, 1), [0, 3]))
    odd = {2: None, 3: b"", 4: b"GIF89a", 5: good[:-4], 6: b"plain text", 7: movie(2, 1)}
    media = spark.createDataFrame([(1, good, "x"), (1, good, "y"), *((k, v, None) for k, v in odd.items()), (None, good, "z")], "media_id long, media binary, frame string")
    rows = gif.frames_table(media).collect()
    ones = sorted((r for r in rows if r["media_id"] == 1), key=lambda r: r["frame"])
    assert [(r["frame"], r["start_cs"], r["delay_cs"], r["visible_share"]) for r in ones] == [(0, 0, 5, 1.0)] * 2 + [(1, 5, 7, 1.0)] * 2
    assert ones[0]["histogram"][48] == 0.5 and ones[0]["histogram"][12] == 0.5  # red, green
    assert ones[2]["histogram"][48] == 0.5 and ones[2]["histogram"][63] == 0.5  # red below a transparent pixel, white
    assert {r["media_id"]: bool(r["error"]) for r in rows if r["frame"] is None} == dict.fromkeys(odd, True)
    assert sum(r["media_id"] is None for r in rows) == 2
    assert gif.frames_table(media.limit(0)).count() == 0


def test_features_are_of_the_frames(spark):
    text = "Grey 0123"
    row = gif.payload_table(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()[0]
    shade = np.bincount(np.frombuffer(text.encode().ljust(64, b"\0"), np.uint8) >> 4, minlength=16)
    assert row["feature"] == "0:" + ",".join(f"{273 * k}={n}" for k, n in enumerate(shade) if n) and row["frames"] == 1

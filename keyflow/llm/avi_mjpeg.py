"""AVI files of motion JPEG: writing, RIFF index parsing, intra frame decoding and shot detection.

The stored form's unit is the quantised DCT coefficient, of which an 8x8 block of three components has 192. A byte b of
the payload is the coefficient d + 1 or, if d is negative, d, where d is b - 109 as a signed byte: never zero, and small
for frequent letters. Coefficients are coded with the standard Huffman tables, which motion-JPEG files leave out of
their frames, so the entropy-coded data hold the payload without loss in codes of 4 to 18 bits; each unit of three
blocks is a restart interval. The decoder reads baseline frames with any tables, their own or the standard ones. It
decodes all restart intervals of many frames side by side, a symbol of each at a time.

Frames are found by the index of AVI 1.0 (`idx1`), by the two-level index of larger files (`indx`, `ix00`), or, without
one, in the lists of chunks, nested ones included.

Shots are cut where the histogram of a frame's luma pixels differs from the frame before by more than the mean plus
three standard deviations of the shot's latest differences, and by `LEAST_CUT` at least. A clip row has its first and
last frame and its times.

Defined results: a null or empty text is stored as one unit of spaces; null media and media that can't be decoded give
one row without a clip, whose `error` says why; equal texts give equal files. Repeated rows each get their row; other
columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT, SIDE, FPS = 192, 16, 25
#: Units in a frame of SIDE x SIDE pixels, and those that are coded or decoded at a time.
PER_FRAME, AT_A_TIME = (SIDE // 8) ** 2, 1 << 13
BINS, LEAST_CUT, MEMORY, DEVIATIONS = 16, 0.35, 12, 3.0
MIDDLE = 109
_ROWS, _BYTES = 200, 2 << 20

# Fixed values of the JPEG standard: for each of its Huffman tables, the numbers of codes of 1 to 16 bits, and the symbols.
DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
    bytes.fromhex(
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a"
        "34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a"
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da"
        "e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"
    ),
)
AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
    bytes.fromhex(
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a"
        "35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a"
        "92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da"
        "e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa"
    ),
)
#: By the number that a frame's scan names them with.
STANDARD = {0x00: DC_LUMA, 0x01: DC_CHROMA, 0x10: AC_LUMA, 0x11: AC_CHROMA}


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


@cache
def lookup(counts: bytes, symbols: bytes):
    """For each 16 bits, the length and the symbol of the code that they begin with, as length << 8 | symbol; 0 for none."""
    import numpy as np

    out = np.zeros(1 << 16, np.int32)
    for (length, code), symbol in huffman(counts, symbols).items():
        out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return out


@cache
def _jpeg_head() -> bytes:
    """Up to the entropy-coded data; without Huffman tables."""
    frame = struct.pack(">BHHB", 8, SIDE, SIDE, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    scan = b"\x03" + b"".join(bytes([c, t]) for c, t in ((1, 0x00), (2, 0x11), (3, 0x11))) + b"\x00\x3f\x00"
    return b"\xff\xd8" + segment(0xDB, b"\0" + b"\x01" * 64) + segment(0xC0, frame) + segment(0xDD, b"\0\1") + segment(0xDA, scan)


@cache
def _byte_codes():
    """For each kind of coefficient (the first and others of luma, of chroma) and byte: its bits, and their number."""
    import numpy as np

    codes, sizes = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for k, table in enumerate((DC_LUMA, AC_LUMA, DC_CHROMA, AC_CHROMA)):
        of = {symbol: key for key, symbol in huffman(*table).items()}
        for byte in range(256):
            d = (byte - MIDDLE + 128) % 256 - 128
            v = d + 1 if d >= 0 else d
            size = abs(v).bit_length()
            length, code = of[size]
            codes[k, byte], sizes[k, byte] = code << size | (v if v > 0 else v + (1 << size) - 1), length + size
    return codes, sizes


def frames_of(payload: bytes) -> list[bytes]:
    """The payload as JPEG frames; the last is filled up with zero bytes."""
    import numpy as np

    data = np.frombuffer(payload + b"\0" * (-len(payload) % (UNIT * PER_FRAME)), np.uint8).reshape(-1, UNIT)
    codes, sizes = _byte_codes()
    kind = np.array([2 * (k >= 64) + (k % 64 > 0) for k in range(UNIT)])
    head, out = _jpeg_head(), []
    for at in range(0, len(data), AT_A_TIME):
        part = data[at : at + AT_A_TIME]
        bits, size = codes[kind, part], sizes[kind, part]
        total = size.sum(1)
        n_bytes = (total + 7) // 8
        starts = np.cumsum(n_bytes) - n_bytes
        # ones fill each unit's last byte
        bits = np.concatenate([bits, ((1 << 8 * n_bytes - total) - 1)[:, None]], axis=1)
        size = np.concatenate([size, (8 * n_bytes - total)[:, None]], axis=1)
        place = (8 * starts[:, None] + np.cumsum(size, axis=1) - size).ravel()
        # each code lies in one or two words of 32 bits
        word, left = place >> 5, 64 - (place & 31) - size.ravel()
        wide = bits.ravel() << left
        n_words = int(n_bytes.sum() + 3) // 4 + 1
        words = np.bincount(word, weights=wide >> 32, minlength=n_words + 1) + np.bincount(word + 1, weights=wide & 0xFFFFFFFF, minlength=n_words + 1)
        coded = words.astype(">u4").view(np.uint8)[: int(n_bytes.sum())]
        # a zero follows each 0xFF, and a restart marker each unit but the last of a frame
        nth = np.arange(len(part)) % PER_FRAME
        last = np.zeros(len(coded), np.int64)
        last[starts + n_bytes - 1] = np.where(nth < PER_FRAME - 1, 2, 0)
        width = 1 + (coded == 0xFF) + last
        to = np.cumsum(width) - width
        flat = np.zeros(int(width.sum()), np.uint8)
        flat[to] = coded
        ends = (to + width)[starts + n_bytes - 1]
        marked = nth < PER_FRAME - 1
        flat[ends[marked] - 2], flat[ends[marked] - 1] = 0xFF, 0xD0 + nth[marked] % 8
        raw, begin = flat.tobytes(), 0
        for end in ends[nth == PER_FRAME - 1].tolist():
            out.append(head + raw[begin:end] + b"\xff\xd9")
            begin = end
    return out


def avi(frames: list[bytes], side: int = SIDE, fps: int = FPS, note: bytes = b"") -> bytes:
    """An AVI 1.0 file with an idx1 index."""
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", bitmap)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", note)) if note else b""
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return chunk(b"RIFF", b"AVI " + head + info + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index)))


def chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """name, start and end of each chunk's data."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def _in_lists(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Frames of a list of chunks, those of nested lists included."""
    for name, a, b in chunks(data, at, end):
        if name == b"LIST":
            yield from _in_lists(data, a + 4, b)
        elif name[2:] in (b"dc", b"db"):
            yield a, b


def _indexed(data: memoryview, at: int) -> Iterator[tuple[int, int]]:
    """Frames by an index of larger files: of frames, or of such indexes."""
    wide, _, kind, n = struct.unpack_from("<HBBI", data, at)
    if kind == 0:
        for k in range(n):
            where = struct.unpack_from("<Q", data, at + 24 + 16 * k)[0]
            yield from _indexed(data, where + 8)
    else:
        base = struct.unpack_from("<Q", data, at + 12)[0]
        for k in range(n):
            offset, size = struct.unpack_from("<II", data, at + 24 + 4 * wide * k)
            yield base + offset, base + offset + (size & 0x7FFFFFFF)


def parse(media: bytes) -> dict:
    """microseconds a frame, note, and the frames' (start, end) by the index, or by the chunks where there is none."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    out: dict = {"step": 40_000, "note": b"", "frames": []}
    movi, index, large = [], None, None
    for riff, start, stop in chunks(data, 0, len(data)):
        if riff != b"RIFF":
            continue
        for name, a, b in chunks(data, start + 4, stop):
            kind = bytes(data[a : a + 4])
            if name == b"LIST" and kind == b"movi":
                movi.append((a, b))
            elif name == b"LIST" and kind in (b"hdrl", b"INFO"):
                for inner, c, d in chunks(data, a + 4, b):
                    if inner == b"avih":
                        out["step"] = struct.unpack_from("<I", data, c)[0]
                    elif inner == b"ICMT":
                        out["note"] = bytes(data[c:d])
                    elif inner == b"LIST" and bytes(data[c : c + 4]) == b"strl":
                        found = {x: e for x, e, _ in chunks(data, c + 4, d)}
                        if b"indx" in found and bytes(data[found[b"strh"] :][:4]) == b"vids":
                            large = large if large is not None else found[b"indx"]
            elif name == b"idx1":
                index = (a, b)
    if not movi:
        raise ValueError("no movi list")
    if large is not None:
        out["frames"] = list(_indexed(data, large))
    elif index is not None:
        entries = [struct.unpack_from("<4sIII", data, at) for at in range(index[0], index[1] - 15, 16)]
        # offsets count from the list's kind, or, as some writers have it, from the file's start
        base = movi[0][0] if not entries or bytes(data[movi[0][0] + entries[0][2] :][:4]) == entries[0][0] else 0
        out["frames"] = [(base + at + 8, base + at + 8 + size) for name, _, at, size in entries if name[2:] in (b"dc", b"db")]
    else:
        out["frames"] = [f for a, b in movi for f in _in_lists(data, a + 4, b)]
    return out


@cache
def header(head: bytes) -> dict:
    """What a JPEG frame's segments up to its entropy-coded data say."""
    import numpy as np

    quant, tables, comps, restart, at = {}, dict(STANDARD), [], 0, 2
    width = height = 0
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            height, width, n = struct.unpack(">HHB", body[1:6])
            comps = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "quant": body[8 + 3 * k]} for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            used = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            if set(used) != {c["id"] for c in comps}:
                raise ValueError("only frames of one scan are decoded")
            for c in comps:
                if c["quant"] not in quant:
                    raise ValueError("a quantisation table is missing")
                c["tables"] = (tables[used[c["id"]] >> 4], tables[0x10 | used[c["id"]] & 15])
                c["quant"] = quant[c["quant"]]
    if not comps or not width or not height:
        raise ValueError("no frame header")
    across, down = -(-width // (8 * max(c["h"] for c in comps))), -(-height // (8 * max(c["v"] for c in comps)))
    blocks = [k for k, c in enumerate(comps) for _ in range(c["v"] * c["h"])]
    return {"width": width, "height": height, "components": comps, "restart": restart, "across": across, "down": down, "blocks": blocks}


def _head_of(jpeg: bytes) -> bytes:
    """The segments up to the entropy-coded data."""
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + size
        if marker == 0xDA:
            return jpeg[:at]
    raise ValueError("a frame without a scan")


def _lanes(head: dict, scans: list[bytes]):
    """The frames' entropy-coded data without stuffing and markers, where each restart interval begins, and its units."""
    import numpy as np

    units = head["across"] * head["down"]
    each = head["restart"] or units
    per_frame = -(-units // each)
    clean, starts, at = [], [], 0
    for scan in scans:
        raw = np.frombuffer(scan, np.uint8)
        after_ff = np.concatenate([[False], raw[:-1] == 0xFF])
        marker = after_ff & (raw >= 0xD0) & (raw <= 0xD7)
        keep = ~(after_ff & (raw == 0)) & ~marker
        keep[:-1] &= ~marker[1:]
        begins = np.concatenate([[0], np.cumsum(keep)[marker]])
        if len(begins) < per_frame:
            raise ValueError("the scan ends early")
        starts.append(at + begins[:per_frame])
        clean.append(raw[keep])
        at += len(clean[-1])
    sizes = np.full(per_frame, each)
    sizes[-1] = units - each * (per_frame - 1)
    return np.concatenate([*clean, np.zeros(8, np.uint8)]), np.concatenate(starts), np.tile(sizes, len(scans)), at


def coefficients(head: dict, scans: list[bytes]):
    """(frames, units, blocks of a unit, 64) coefficients in zigzag order, of frames that share a header."""
    import numpy as np

    data, starts, units, end = _lanes(head, scans)
    comps, blocks = head["components"], np.array(head["blocks"])
    windows = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        windows |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    tables = np.stack([lookup(*t) for c in comps for t in c["tables"]])
    n_blocks = units * len(blocks)
    out = np.zeros((len(starts), int(n_blocks.max()) * 64), np.int32)
    lane, bit, block, at = np.arange(len(starts)), 8 * starts, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    while len(lane):
        if (bit >= 8 * end).any():
            raise ValueError("the scan ends early")
        window = windows[bit >> 3] << (bit & 7).astype(np.uint64)
        found = tables[2 * blocks[block % len(blocks)] + (at > 0), (window >> np.uint64(48)).astype(np.int64)]
        length, run, size = found >> 8, found >> 4 & 15, found & 15
        run[at == 0] = 0
        if (found == 0).any():
            raise ValueError("no such code")
        extra = (window << length.astype(np.uint64) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra >> np.maximum(size - 1, 0) & 1 | (size == 0), extra, extra - (1 << size) + 1)
        bit = bit + length + size
        over = (at > 0) & (size == 0) & (run < 15)  # no more of this block
        at = at + run
        if (at[~over] > 63).any():
            raise ValueError("a block has too many coefficients")
        write = ~over
        out[lane[write], 64 * block[write] + at[write]] = value[write]
        at = np.where(over, 64, at + 1)
        full = at >= 64
        block, at = block + full, np.where(full, 0, at)
        left = block < n_blocks[lane]
        if not left.all():
            lane, bit, block, at = lane[left], bit[left], block[left], at[left]
    out = out.reshape(len(starts), -1, len(blocks), 64)
    for k in range(len(comps)):  # first coefficients are differences within a restart interval
        own = np.flatnonzero(blocks == k)
        first = out[:, :, own, 0].reshape(len(starts), -1)
        out[:, :, own, 0] = np.cumsum(first, axis=1).reshape(len(starts), -1, len(own))
    per_frame = len(starts) // len(scans)
    return out.reshape(len(scans), per_frame * out.shape[1], len(blocks), 64)[:, : head["across"] * head["down"]]


def decode(jpegs: list[bytes]) -> Iterator[tuple[int, dict, object]]:
    """For runs of frames that share a header: the number of the first, the header, and the frames' coefficients."""
    a = 0
    while a < len(jpegs):
        head = _head_of(jpegs[a])
        found = header(head)
        most = max(1, AT_A_TIME // (found["across"] * found["down"]))
        b = a
        while b < len(jpegs) and b - a < most and jpegs[b].startswith(head):
            b += 1
        ends = [x.rfind(b"\xff\xd9") for x in jpegs[a:b]]
        yield a, found, coefficients(found, [x[len(head) : e if e >= len(head) else len(x)] for x, e in zip(jpegs[a:b], ends)])
        a = b


@cache
def _transform():
    """From 64 coefficients in zigzag order to 64 pixels, times 2**13, in whole numbers: sums are exact in any order."""
    import numpy as np

    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 1 / 2)
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.rint(np.array([np.outer(basis[:, y], basis[:, x]).ravel() for y, x in order]) * (1 << 13))


def planes(head: dict, found, k: int):
    """(frames, height, width) pixels of the k-th component of frames, in whole blocks."""
    import numpy as np

    c = head["components"][k]
    own = np.flatnonzero(np.array(head["blocks"]) == k)
    values = (found[:, :, own] * c["quant"]).astype(np.float64) @ _transform()
    pixels = np.clip(np.floor(values / (1 << 13) + 0.5) + 128, 0, 255).astype(np.uint8)
    grid = pixels.reshape(len(found), head["down"], head["across"], c["v"], c["h"], 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
    return grid.reshape(len(found), head["down"] * c["v"] * 8, head["across"] * c["h"] * 8)


def histograms(head: dict, found):
    """Shares of the luma pixels in BINS equal ranges, for each frame."""
    import numpy as np

    pixels = planes(head, found, 0)[:, : head["height"], : head["width"]].reshape(len(found), -1)
    which = (pixels.astype(np.int64) * BINS >> 8) + BINS * np.arange(len(found))[:, None]
    return np.bincount(which.ravel(), minlength=BINS * len(found)).reshape(len(found), BINS) / pixels.shape[1]


def read_back(frames: list[bytes]) -> tuple[bytes, object]:
    """The bytes that the frames' coefficients hold, and the frames' histograms."""
    import numpy as np

    parts, shares = [], []
    for _, head, found in decode(frames):
        parts.append((np.where(found > 0, found - 1, found) + MIDDLE).astype(np.uint8).tobytes())
        shares.append(histograms(head, found))
    return b"".join(parts), np.concatenate(shares)


def clips(shares, step: int) -> list[tuple[int, int, float, float, float]]:
    """first frame, last frame, start and end in seconds, and the difference at the start, of each shot of frames with
    these histograms."""
    import numpy as np

    if not len(shares):
        return []
    starts, cuts, latest = [0], [0.0], []
    differences = (np.abs(np.diff(shares, axis=0)).sum(1) / 2).tolist()
    for k, d in enumerate(differences, 1):
        limit = LEAST_CUT
        if latest and d > LEAST_CUT:
            mean = sum(latest) / len(latest)
            limit = max(LEAST_CUT, mean + DEVIATIONS * (sum((x - mean) ** 2 for x in latest) / len(latest)) ** 0.5)
        if d > limit:
            starts.append(k)
            cuts.append(d)
            latest = []
        else:
            latest = [*latest, d][-MEMORY:]
    ends = [*starts[1:], len(shares)]
    return [(a, b - 1, a * step / 1e6, b * step / 1e6, c) for a, b, c in zip(starts, ends, cuts)]


def padded(text: bytes) -> bytes:
    return text + b" " * (UNIT if not text else -len(text) % UNIT)


def _file(frames: list[bytes], payload: bytes) -> bytes:
    return avi(frames, note=b"payload_bytes=%d" % len(payload))


def store(text: bytes) -> bytes:
    payload = padded(text)
    return _file(frames_of(payload), payload)


def store_all(texts: list[bytes]) -> list[bytes]:
    """The files of texts, whose frames are coded together."""
    payloads = [padded(t) for t in texts]
    whole = UNIT * PER_FRAME
    frames, at, out = frames_of(b"".join(p + b"\0" * (-len(p) % whole) for p in payloads)), 0, []
    for p in payloads:
        n = -(-len(p) // whole)
        out.append(_file(frames[at : at + n], p))
        at += n
    return out


def read_all(files: list[bytes]) -> list[tuple[bytes, object, int]]:
    """Payload, histograms and microseconds a frame of files, whose frames are decoded together."""
    found = [parse(m) for m in files]
    data, shares = read_back([m[a:b] for m, f in zip(files, found) for a, b in f["frames"]])
    out, at = [], 0
    for f in found:
        n, size = len(f["frames"]), int(f["note"].rstrip(b"\0").split(b"=")[1])
        start = at * UNIT * PER_FRAME
        out.append((data[start : start + size], shares[at : at + n], f["step"]))
        at += n
    return out


def shots(media: bytes | None) -> tuple[list[tuple], str | None]:
    """The clips of a file, or none and why."""
    import numpy as np

    if media is None:
        return [], "no media"
    try:
        found = parse(media)
        shares = [histograms(head, c) for _, head, c in decode([media[a:b] for a, b in found["frames"]])]
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return [], str(e) or type(e).__name__
    return clips(np.concatenate(shares) if shares else [], found["step"]), None


_CLIPS = "media_id long, clip int, first_frame int, last_frame int, start_s double, end_s double, error string"


def clip_rows(videos: DataFrame) -> DataFrame:
    """media_id, clip, first_frame, last_frame, start_s, end_s, error, for media_id, media (the bytes of an AVI file)."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        for batch in common.slices(batches, 20):
            out: list[tuple] = []
            for media_id, media in zip(*(c.to_pylist() for c in batch.columns)):
                found, error = shots(media)
                out += [(media_id, k, a, b, s, e, None) for k, (a, b, s, e, _) in enumerate(found)]
                if error is not None:
                    out.append((media_id, None, None, None, None, None, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=[x.split()[0] for x in _CLIPS.split(", ")])

    return videos.select("media_id", "media").mapInArrow(rows, _CLIPS)


def stored_media(docs: DataFrame) -> DataFrame:
    """media_id, media of every row: its text as an AVI file."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches, 50):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(t) for t in common.utf8(batch.column(1))], pa.binary())], names=["media_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(rows, "media_id long, media binary")


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back, and describe both."""

    def rows(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        def described(ids: list, texts: list[bytes]):
            out = []
            files = store_all(texts)
            for doc_id, text, media, (payload, shares, step) in zip(ids, texts, files, read_all(files)):
                found = ",".join(f"{s:.2f}-{e:.2f}" for _, _, s, e, _ in clips(shares, step))
                out.append((doc_id, len(text), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), f"frames={len(shares)};clips={found}"))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])

        for batch in common.slices(batches, _ROWS):
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1))):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size > _BYTES:
                    yield described(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield described(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(rows, _DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))

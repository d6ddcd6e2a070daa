"""GIF: writing and reading of the whole format, and a media column over it.

Reading follows the file: screen, global and local palettes, graphic control (delay, disposal, transparency), interlace,
LZW code streams of any minimum code size with clear codes anywhere. Frames are composed on the canvas as a viewer would, and
each keeps its indices, its delay and a colour histogram.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from quarry.llm.common import sliced

#: A payload is cut into frames of SIDE x SIDE samples; GREYS is their palette: 256 levels, one for each byte.
SIDE = 24
FRAME = SIDE * SIDE
GREYS = bytes(v for i in range(256) for v in (i, i, i))
DELAY = 4
LIMIT = 4096


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: bytes
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: tuple[int, int, int] = (0, 0, 0)
    frames: list[Frame] = field(default_factory=list)


def lzw_codes(data: bytes, bits: int = 8) -> list[int]:
    """The codes of a stream. A clear code stands first and again before the table could fill up, an end code last."""
    clear = 1 << bits
    room = LIMIT - clear - 2
    codes: list[int] = []
    add = codes.append
    for k in range(0, max(len(data), 1), room):
        add(clear)
        table: dict[int, int] = {}
        get, fresh = table.get, clear + 2
        part = iter(data[k : k + room])
        now = next(part, None)
        for b in part:
            key = now << 8 | b
            if (code := get(key)) is None:
                add(now)
                table[key] = fresh
                fresh += 1
                now = b
            else:
                now = code
        if now is not None:
            add(now)
    add(clear + 1)
    return codes


_TABLES: dict[int, np.ndarray] = {}


def _widths(bits: int) -> np.ndarray:
    """Bits of the k-th code after a clear code. The reader adds an entry for each code but the first, so it knows k - 1
    entries before code k, and widens as soon as the next entry needs more bits."""
    if bits not in _TABLES:
        known = (1 << bits) + 2 + np.maximum(np.arange(LIMIT * 2) - 1, 0)
        _TABLES[bits] = np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(known)).astype(np.int64) + 1))
    return _TABLES[bits]


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the codes after a clear code: width, first bit, end bit, and which of 16 bits count."""
    if bits not in _LAYOUTS:
        width = _widths(bits)
        ends = np.cumsum(width)
        _LAYOUTS[bits] = width, ends - width, ends, np.arange(16) < width[:, None]
    return _LAYOUTS[bits]


_LAYOUTS: dict[int, tuple] = {}


def pack(codes: list[int], bits: int = 8) -> bytes:
    """Codes to bytes, least bit first."""
    values = np.array(codes, "<u2")
    each = np.unpackbits(values.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    width, _, _, counts = _layout(bits)
    starts = [*np.flatnonzero(values == 1 << bits).tolist(), len(values) - 1]
    parts = [each[0, : bits + 1]]
    for s, e in zip(starts, starts[1:], strict=False):
        parts.append(each[s + 1 : e + 1][counts[: e - s]])
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    return pack(lzw_codes(data, bits), bits)


def lzw_decode(data: bytes, bits: int, wanted: int) -> bytes:
    """The samples of a code stream, at most ``wanted``; a damaged or short stream gives what could be read.

    Between clear codes the width of every code follows from its place, so each stretch is unpacked at once.
    """
    clear, stop, (width, begin, end, _) = 1 << bits, (1 << bits) + 1, _layout(bits)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    first = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, have, got = 0, len(data) * 8, 0
    if have > bits and (int(raw[0]) | int(raw[1]) << 8) & (2 << bits) - 1 == clear:
        at = bits + 1
    while at < have and got < wanted:
        n = min(len(width), wanted - got + 2, int(np.searchsorted(end, have - at, side="right")))
        place = begin[:n] + at
        byte = place >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7) & ((1 << width[:n]) - 1)
        breaks = np.flatnonzero((codes == clear) | (codes == stop))
        upto = int(breaks[0]) if len(breaks) else n
        more = len(breaks) > 0 and int(codes[upto]) == clear
        run = iter(codes[:upto].tolist())
        table = first[:]
        last = table[code] if (code := next(run, clear)) < clear else b""
        more &= upto == 0 or code < clear
        if last:
            add, put = table.append, out.append
            put(last)
            for code in run:
                try:
                    entry = table[code]
                except IndexError:
                    if code != len(table):
                        more, run = False, iter(())
                        break
                    entry = last + last[:1]
                add(last + entry[:1])
                put(entry)
                last = entry
                if code >= LIMIT - 1 or len(table) >= LIMIT:
                    break
            for code in run:  # the table is full
                put(table[code])
        if not more:
            break
        at += int(end[upto])
        got = sum(map(len, out))
    return b"".join(out)[:wanted]


def lzw_decode_all(streams: list[bytes], bits: list[int], wanted: list[int]) -> list[bytes]:
    """Decode several code streams at once where they allow it, one by one where not.

    In a stream with no clear code but the first, entry e of the table repeats what code e gave and one more sample, and
    both lie in the output. So each code is a sample or a copy of earlier output, lengths follow from chains of entries,
    and samples from chains of copies; doubling resolves either kind of chain for all streams together.
    """
    out: list[bytes | None] = [None] * len(streams)
    groups: dict[int, list[int]] = {}
    for i, (b, n) in enumerate(zip(bits, wanted, strict=True)):
        if 0 < n <= LIMIT - (1 << b) - 2 and len(streams[i]) <= 2 * n + 8:
            groups.setdefault(b, []).append(i)
    for b, members in groups.items():
        for k in range(0, len(members), 256):
            for i, data in zip(part := members[k : k + 256], _decode_simple([streams[i] for i in part], b, [wanted[i] for i in part]), strict=True):
                out[i] = data
    return [lzw_decode(streams[i], bits[i], wanted[i]) if x is None else x for i, x in enumerate(out)]


def _decode_simple(streams: list[bytes], bits: int, wanted: list[int]) -> list[bytes | None]:
    """None for each stream with a second clear code, without an end code, of another length than wanted, or damaged."""
    clear, (width, begin, end, _) = 1 << bits, _layout(bits)
    count, sizes = len(streams), np.array([len(s) for s in streams])
    longest = int(sizes.max())
    raw = np.frombuffer(b"".join(s.ljust(longest + 3, b"\0") for s in streams), np.uint8).reshape(count, -1).astype(np.int32)
    n = int(np.searchsorted(end, longest * 8 - bits - 1, side="right"))
    if n < 1:
        return [None] * count
    place = begin[:n] + bits + 1
    byte, shift = place >> 3, (place & 7).astype(np.int32)
    codes = (raw[:, byte] | raw[:, byte + 1] << 8 | raw[:, byte + 2] << 16) >> shift & ((1 << width[:n]) - 1).astype(np.int32)
    special = (codes == clear) | (codes == clear + 1)
    stop = special.argmax(1)
    rows = np.arange(count)
    good = special[rows, stop] & (codes[rows, stop] == clear + 1) & ((raw[:, 0] | raw[:, 1] << 8) & (2 << bits) - 1 == clear)
    good &= (end[stop] + bits + 1 <= sizes * 8) & (stop > 0)
    at = np.arange(n)
    known = (at < stop[:, None]) & good[:, None]
    entry = codes - (clear + 2)
    good &= ~((entry >= np.maximum(at, 0)) & known).any(1)
    known &= good[:, None]
    row, col = np.nonzero(known)
    if not len(row):
        return [None] * count
    code = codes[row, col]
    number = np.arange(len(code))
    parent = np.where(code < clear, number, number - col + entry[row, col])  # the code whose output an entry extends
    length = np.where(code < clear, 1, 2)
    hop, add = parent, length - 1
    while True:  # length of a code: one more than that of its parent
        nxt = hop[hop]
        more = add[hop]
        if not more.any():
            break
        add, hop = add + more, nxt
    length = add + 1
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    of = np.repeat(number, length)
    source = np.where((code < clear)[of], np.arange(total), start[parent][of] + np.arange(total) - start[of])
    while True:
        nxt = source[source]
        if np.array_equal(nxt, source):
            break
        source = nxt
    samples = code.astype(np.uint8)[of[source]].tobytes()
    made = np.zeros(count, np.int64)
    np.add.at(made, row, length)
    last = np.cumsum(made)
    return [samples[e - m : e] if g and m == w else None for g, m, e, w in zip(good.tolist(), made.tolist(), last.tolist(), wanted, strict=True)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(part),)) + part for part in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def write(gif: Gif, palette: bytes = GREYS) -> bytes:
    """The file: frames that share ``palette`` use it as the global one, others carry their own."""
    bits = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0x80 | 7 << 4 | bits - 1, 0, 0), palette.ljust(3 << bits, b"\0")]
    for f in gif.frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0")
        own, low = f.palette != palette, max(1, (len(f.palette) // 3 - 1).bit_length())
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, (0x80 | low - 1) if own else 0))
        if own:
            out.append(f.palette.ljust(3 << low, b"\0"))
        code_bits = max(2, low)
        out.append(bytes((code_bits,)) + _blocks(lzw_encode(f.indices, code_bits)))
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _room(data: bytes) -> int:
    """Samples that codes in so many bytes can stand for at most; a few rows of padding for files that are cut off."""
    return LIMIT * (len(data) * 8 // 3 + 16)


def _rows(height: int) -> list[int]:
    """Order in which an interlaced frame stores its rows."""
    return [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]


def read(data: bytes) -> Gif:
    """Parse a file. A file that is cut off gives the frames before the cut; what is no GIF raises ValueError.

    So does a file whose screen or frames have more samples than codes of its length can stand for (a code has 3 bits at
    least and repeats fewer than LIMIT samples), so memory is bounded by the bytes that are there and not by what they claim.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, back = struct.unpack_from("<HHBB", data, 6)
    if width * height > _room(data):
        raise ValueError("the screen is larger than the file can fill")
    at, palette = 13, GREYS
    if flags & 0x80:
        palette = data[at : at + (3 << (flags & 7) + 1)]
        at += len(palette)
    gif = Gif(width, height, tuple(palette[3 * back : 3 * back + 3].ljust(3, b"\0")) if flags & 0x80 else (0, 0, 0))
    delay, disposal, transparent = 0, 0, None
    found: list[tuple[bytes, int, bool]] = []
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            label, (body, at) = data[at + 1], _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            own = palette
            if flags & 0x80:
                own = data[at : at + (3 << (flags & 7) + 1)]
                at += len(own)
            if at >= len(data):
                break
            bits = data[at]
            stream, at = _sub_blocks(data, at + 1)
            if w * h > _room(stream):
                raise ValueError("a frame is larger than its codes can fill")
            found.append((stream if 1 <= bits <= 8 else b"", min(max(bits, 1), 8), bool(flags & 0x40)))
            gif.frames.append(Frame(left, top, w, h, b"", own, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            break
    decoded = lzw_decode_all([x[0] for x in found], [x[1] for x in found], [f.width * f.height for f in gif.frames])
    for f, indices, (_, _, interlaced) in zip(gif.frames, decoded, found, strict=True):
        f.indices = indices.ljust(f.width * f.height, b"\0")
        if interlaced:
            grid = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)
            straight = np.empty_like(grid)
            straight[_rows(f.height)] = grid
            f.indices = straight.tobytes()
    return gif


def compose(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas (height x width x RGBA) as it shows at each frame; disposal acts before the next one."""
    canvas, last = np.zeros((gif.height, gif.width, 4), np.uint8), None
    for f in gif.frames:
        box = slice(f.top, min(f.top + f.height, gif.height)), slice(f.left, min(f.left + f.width, gif.width))
        before = canvas.copy() if f.disposal == 3 else None
        if f.palette is not last:
            colours, last = np.zeros((256, 4), np.uint8), f.palette
            rgb = np.frombuffer(last[: len(last) // 3 * 3], np.uint8).reshape(-1, 3)
            colours[: len(rgb), :3], colours[: len(rgb), 3] = rgb, 255
        index = np.frombuffer(f.indices, np.uint8).reshape(f.height, f.width)[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        part = canvas[box]
        part[...] = colours[index] if f.transparent is None else np.where((index == f.transparent)[..., None], part, colours[index])
        yield canvas.copy()
        if f.disposal == 2:
            canvas[box] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels of a canvas in 64 colours: the two high bits of red, green and blue; see-through pixels are not counted."""
    high = canvas.reshape(-1, 4) >> 6
    colour = high[:, 0] << 4 | high[:, 1] << 2 | high[:, 2] | (high[:, 3] == 0) << 6
    return np.bincount(colour, minlength=65)[:64]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, filled up with bytes 255 to a positive multiple of FRAME; and its own length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def store(payload: bytes) -> bytes:
    """An animated greyscale GIF of SIDE x SIDE frames, one sample for each byte."""
    parts = (payload[k : k + FRAME] for k in range(0, len(payload), FRAME))
    return write(Gif(SIDE, SIDE, frames=[Frame(0, 0, SIDE, SIDE, p, GREYS, DELAY) for p in parts]))


def samples(gif: Gif) -> bytes:
    """The 8-bit samples read back, frame after frame."""
    return b"".join(f.indices for f in gif.frames)


def feature_of(gif: Gif) -> str:
    """Frames, total delay, and the summed histogram's non-empty colours, as text."""
    total = sum((histogram(c) for c in compose(gif)), np.zeros(64, np.int64))
    return f"{len(gif.frames)};{sum(f.delay for f in gif.frames)};" + ",".join(f"{k}:{total[k]}" for k in np.flatnonzero(total))


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FRAMES = "frame int, width int, height int, delay int, rgba binary, histogram array<long>"
#: Pixel bytes that a worker gathers before it hands frames on.
HANDED = 1 << 24


def digest(text: str | None) -> tuple:
    payload, n = payload_of(text)
    media = store(payload)
    gif = read(media)
    back = samples(gif)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(gif)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a GIF, read the bytes back and describe them: doc_id and the columns of DIGEST.

    A null text is an empty one: one frame of bytes 255. Every row gives one row, equal texts equal values. Only the named
    columns are read, so other columns can have any names.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [digest(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {DIGEST}")


def decode_column(media: DataFrame, id_col: str = "id", gif_col: str = "media") -> DataFrame:
    """Decode a binary column of GIF files into timed frames, a row each: id and the columns of FRAMES.

    frame counts from 0, delay is in hundredths of a second, rgba is the canvas as it shows at the frame (width x height x 4 bytes),
    histogram its pixels in 64 colours. Null bytes, bytes that are no GIF, files that claim more samples than they can hold, and files
    without a frame give one row with null columns after the id; a file that is cut off gives the frames before the cut. Repeated rows give
    repeated rows, an empty table an empty result. Frames are handed on as they are composed, so a long file doesn't fill
    the memory. Only the named columns are read, so other columns can have any names.
    """
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in FRAMES.split(", ")]

    def frames(data: bytes | None) -> Iterator[tuple]:
        try:
            gif = read(data or b"")
        except ValueError:
            gif = Gif(0, 0)
        for k, (f, c) in enumerate(zip(gif.frames, compose(gif), strict=True)):
            yield k, gif.width, gif.height, f.delay, c.tobytes(), histogram(c).tolist()
        if not gif.frames:
            yield (None,) * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", *names])

        for batch in sliced(batches):
            of, rows, held = [], [], 0
            for i, data in enumerate(batch.column(1)):
                for row in frames(data.as_py()):
                    of.append(i)
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held > HANDED:
                        yield handed()
                        of, rows, held = [], [], 0
            if rows:
                yield handed()

    rows = media.selectExpr(f"`{id_col}` AS id", f"`{gif_col}` AS media")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, {FRAMES}")

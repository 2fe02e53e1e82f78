"""Operator 10: media columns: TIFF.

pages(): walks the image directories of each TIFF in a binary column and gives a row for each page, with its samples. Strips and tiles,
stored plainly or by PackBits, LZW or deflate; horizontal predictor; 8 or 16 bits; chunky or planar samples; either byte order.
write(): makes TIFFs of pages; encode_texts(): of texts' bytes, without loss.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import batch, id_text, map_arrow, pick, place

# Fixed values of the TIFF format: tags, field types with their sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPE_SIZES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: How many bytes one byte of a compression may become, at most: a bound on what a header may ask for.
SWELLS = {PLAIN: 1, PACKBITS: 64, DEFLATE: 1040, OLD_DEFLATE: 1040, LZW: 4096}

ROW = 576  # bytes of a text in a row of samples
STRIP_ROWS = 113  # about 64 KB


# ---- compressions ----


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends; widths change one code early."""
    table: list[bytes] = []
    out, last = bytearray(), b""
    bits = held = 0
    width, at = 9, 0
    while len(out) < size:
        while held < width:
            if at >= len(data):
                return bytes(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFFFF
            held, at = held + 8, at + 1
        held -= width
        code = bits >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if not last:
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise ValueError("a bad LZW code")
        out += word
        last = word
        width = min(12, (len(table) + 1).bit_length()) if len(table) >= 511 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, held, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def clear() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size >= 4094:
            clear()
        elif size >= 511:
            width = min(12, size.bit_length())
        word = data[i : i + 1]
    if word:
        put(table[word])
        if len(table) + 3 >= 511:
            width = min(12, (len(table) + 3).bit_length())
    put(257)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def unpack(data: bytes, how: int, size: int) -> bytes:
    if how == PLAIN:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {how} is not supported")


def compress(data: bytes, how: int) -> bytes:
    return data if how == PLAIN else zlib.compress(data, 6) if how in (DEFLATE, OLD_DEFLATE) else lzw_encode(data) if how == LZW else packbits_encode(data)


# ---- files ----


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    pixels: np.ndarray  # (height, width, samples)


class Tiff:
    def __init__(self, data: bytes):
        self.data = data
        if data[:4] not in (b"II*\0", b"MM\0*"):
            raise ValueError("not a TIFF")
        self.order = "<" if data[:2] == b"II" else ">"

    def directories(self) -> Iterator[dict[int, tuple]]:
        seen: set[int] = set()
        (at,) = struct.unpack_from(self.order + "I", self.data, 4)
        while at:
            if at in seen:
                raise ValueError("image directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(self.order + "H", self.data, at)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * i)
                if kind in TYPE_SIZES:
                    size, letter = TYPE_SIZES[kind]
                    place = at + 10 + 12 * i
                    if size * count > 4:
                        (place,) = struct.unpack_from(self.order + "I", self.data, place)
                    tags[tag] = struct.unpack_from(f"{self.order}{count}{letter}", self.data, place)
            yield tags
            (at,) = struct.unpack_from(self.order + "I", self.data, at + 2 + 12 * n)

    def page(self, tags: dict[int, tuple]) -> Page:
        one = lambda tag, default=None: tags[tag][0] if tag in tags else default
        width, height, samples, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
        bits = tags.get(BITS, (1,))
        if len(set(bits)) != 1 or bits[0] not in (8, 16):
            raise ValueError("only 8 or 16 bits a sample are supported")
        if not width or not height or not samples or planar not in (1, 2):
            raise ValueError("a page without width, height or samples, or of unknown planes")
        how, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if how not in SWELLS:
            raise ValueError(f"compression {how} is not supported")
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} is not supported")
        kind = np.dtype(np.uint8) if bits[0] == 8 else np.dtype(self.order + "u2")
        if TILE_OFFSETS in tags:
            tw, th, offsets, sizes = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags.get(TILE_BYTES, ())
        else:
            tw, th, offsets, sizes = width, min(one(ROWS_PER_STRIP, height), height) or 1, tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
        if not tw or not th:
            raise ValueError("tiles without width or height")
        per = samples if planar == 1 else 1
        across, down = -(-width // tw), -(-height // th)
        if len(offsets) < across * down * (samples // per) or len(sizes) < len(offsets):
            raise ValueError("strips or tiles are missing")
        # Before memory is taken: the header can't ask for more than the stored bytes can become.
        if width * height * samples * kind.itemsize > SWELLS[how] * sum(min(n, len(self.data)) for n in sizes):
            raise ValueError("strips or tiles are too short for the page")
        out = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
        for k in range(across * down * (samples // per)):
            plane, cell = divmod(k, across * down)
            y, x = cell // across * th, cell % across * tw
            rows = th if TILE_OFFSETS in tags else min(th, height - y)
            size = rows * tw * per * kind.itemsize
            raw = unpack(self.data[offsets[k] : offsets[k] + sizes[k]], how, size)
            if len(raw) < size:
                raise ValueError("a strip or tile ends early")
            block = np.frombuffer(raw, dtype=kind, count=size // kind.itemsize).reshape(rows, tw, per)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=out.dtype)
            h, w = min(rows, height - y), min(tw, width - x)
            if per == samples:
                out[y : y + h, x : x + w] = block[:h, :w]
            else:
                out[y : y + h, x : x + w, plane] = block[:h, :w, 0]
        return Page(width, height, samples, bits[0], out)

    def pages(self) -> Iterator[Page]:
        for tags in self.directories():
            yield self.page(tags)


def write(pages: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of arrays (height, width) or (height, width, samples) of 8 or 16 bits; tile: its height and width, multiples of 16."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4)
    link = 4
    for image in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        bits = image.dtype.itemsize * 8
        th, tw = tile or (min(strip_rows, max(height, 1)), width)
        offsets, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                data = compress(np.ascontiguousarray(block.astype(block.dtype.newbyteorder(order))).tobytes(), compression)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) % 2)
        photometric = 2 if samples >= 3 else 1
        where = [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [th]), (STRIP_BYTES, 4, sizes)]
        fields = sorted([(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [photometric]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), *where])
        placed = []
        for tag, kind, values in fields:
            size, letter = TYPE_SIZES[kind]
            data = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out += data + b"\0" * (len(data) % 2)
                data = place
            placed.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(placed)) + b"".join(placed)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def feature(pixels: np.ndarray) -> str:
    """Size, mean, standard deviation and an 8-bin histogram of samples."""
    flat = pixels.ravel().astype(np.int64)
    n, s, q = max(len(flat), 1), int(flat.sum()), int((flat * flat).sum())
    shift = 5 if pixels.dtype.itemsize == 1 else 13
    bins = np.bincount(flat >> shift, minlength=8)
    return f"{pixels.shape[1]}x{pixels.shape[0]}x{pixels.shape[2]} mean={s / n:.4f} sd={max(0.0, q / n - (s / n) ** 2) ** 0.5:.4f} hist={','.join(map(str, bins.tolist()))}"


# ---- tables ----


def encode_texts(docs: DataFrame, *, compression: int = DEFLATE, predictor: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up with 255 to a positive multiple of ROW, as a page ROW wide.

    A null or empty text is one row of 255s. A row for each row, also for null or repeated ids; an empty table gives an empty one; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                data += b"\xff" * (ROW - len(data) if not data else -len(data) % ROW)
                media.append(write([np.frombuffer(data, dtype=np.uint8).reshape(-1, ROW)], compression=compression, predictor=predictor))
            yield batch({"doc_id": b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})

    return map_arrow(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


FAULTS = (ValueError, struct.error, zlib.error, LookupError, ArithmeticError, MemoryError, TypeError)
PAGE = "doc_id long, page int, width long, height long, samples int, bits int, pixels binary, feature string, media_bytes long, error string"


def pages(table: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", carry: list[str] | None = None) -> DataFrame:
    """PAGE's columns, then those named in carry, a row for each page (numbered from 0); pixels: samples row by row, little-endian.

    Media that is null, not a TIFF, or whose directories are broken gives a row with null page and the reason in `error`, after the pages
    before the fault. A page that can't be decoded has its number and the reason; those after it follow. An empty table gives an empty
    one; repeated rows are read each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            at: list[int] = []
            held = 0
            for i, (doc, media) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                try:
                    if media is None:
                        raise ValueError("no media")
                    tiff = Tiff(media)
                    for k, tags in enumerate(tiff.directories()):
                        try:
                            p = tiff.page(tags)
                        except FAULTS as e:
                            rows.append((doc, k, *[None] * 6, len(media), str(e) or type(e).__name__))
                            at.append(i)
                            continue
                        rows.append((doc, k, p.width, p.height, p.samples, p.bits, p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes(), feature(p.pixels), len(media), None))
                        at.append(i)
                        held += p.pixels.nbytes
                        if held > 16 << 20:
                            yield table_of(rows, b, at)
                            rows, at, held = [], [], 0
                except FAULTS as e:
                    rows.append((doc, *[None] * 7, None if media is None else len(media), str(e) or type(e).__name__))
                    at.append(i)
            if rows:
                yield table_of(rows, b, at)

    def table_of(rows: list[tuple], b: pa.RecordBatch, at: list[int]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*own, *[c.take(pa.array(at)) for c in b.columns[2:]]], names=[*[x.split()[0] for x in PAGE.split(", ")], *names])

    names = carry or []
    others = [f", `{n}` {table.schema.fields[place(table, n)].dataType.simpleString()}" for n in names]
    return map_arrow(pick(table, doc_id=(id_col, "long"), media=media_col, **{f"x{i}": n for i, n in enumerate(names)}), run, PAGE + "".join(others))

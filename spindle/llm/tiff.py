"""TIFF media columns: image directories, strips and tiles, codecs and predictors.

``pages_of`` reads classic TIFF of either byte order: it walks the chain of
image directories, decodes uncompressed, PackBits, LZW and deflate strips and
tiles, and undoes horizontal differencing. ``encode_pages`` writes the same
kinds, which makes test input and lossless storage of byte payloads.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import sliced

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Tags of the TIFF 6.0 directory that are read or written here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
# Field type -> size and struct code.
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}

PAGE_FIELDS = (
    "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, "
    "n_chunks int, mean double, pixels binary, error string"
)


@dataclass
class Page:
    page: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    compression: int = NONE
    predictor: int = 1
    tiled: bool = False
    n_chunks: int = 0
    mean: float | None = None
    pixels: bytes | None = None
    error: str | None = None


# ---- codecs ---------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            i += 2
        else:
            i += 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(end: int) -> None:
        for a in range(at, end, 128):
            part = data[a : min(a + 128, end)]
            out.append(bytes([len(part) - 1]))
            out.append(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(bytes([257 - (m.end() - m.start()), data[m.start()]]))
        at = m.end()
    literal(len(data))
    return b"".join(out)


_SINGLE = [bytes([i]) for i in range(256)]


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF LZW: most significant bit first, codes grow one early, 256 clears, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = [*_SINGLE, b"", b""]
    width, held, bits, made = 9, 0, 0, 0
    before = None
    top = 511
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code < 256 or code > 257:
            n = len(table)
            if before is None:
                entry = table[code]
            elif code < n:
                entry = table[code]
                table.append(before + entry[:1])
            elif code == n:
                entry = before + before[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code beyond the table")
            out.append(entry)
            made += len(entry)
            before = entry
            if len(table) >= top and width < 12:
                width += 1
                top = (1 << width) - 1
        elif code == 256:
            del table[258:]
            width, top, before = 9, 511, None
        else:
            break
        if made >= size:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    put = codes.append
    table = {s: i for i, s in enumerate(_SINGLE)}
    width, following, top = 9, 258, 511
    at, n = 0, len(data)
    while at < n:
        end = at + 1
        code = data[at]
        while end < n and (longer := table.get(data[at : end + 1])) is not None:
            code = longer
            end += 1
        put((code, width))
        if end < n:
            table[data[at : end + 1]] = following
            following += 1
            # the reader's table is one entry behind
            if following > top and width < 12:
                width += 1
                top = (1 << width) - 1
            elif following == 4094:
                put((256, width))
                table = {s: i for i, s in enumerate(_SINGLE)}
                width, following, top = 9, 258, 511
        at = end
    put((257, width))
    return _bits(codes)


def _bits(codes: list[tuple[int, int]]) -> bytes:
    out, held, bits = bytearray(), 0, 0
    for code, width in codes:
        held = held << width | code
        bits += width
        if bits >= 512:
            rest = bits & 7
            out += (held >> rest).to_bytes((bits - rest) // 8, "big")
            held &= (1 << rest) - 1
            bits = rest
    if bits:
        pad = -bits % 8
        out += (held << pad).to_bytes((bits + pad) // 8, "big")
    return bytes(out)


def _decoded(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return raw
    if compression == PACKBITS:
        return unpack_bits(raw)
    if compression == LZW:
        return lzw_decode(raw, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(raw, size)
    raise ValueError(f"compression {compression} is not supported")


# ---- reading --------------------------------------------------------------


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, after


def _image(data: bytes, tags: dict[int, tuple], order: str, page: Page) -> None:
    one = lambda tag, default: tags[tag][0] if tags.get(tag) else default
    page.width, page.height = one(WIDTH, 0), one(HEIGHT, 0)
    page.samples, page.bits = one(SAMPLES, 1), one(BITS, 1)
    page.compression, page.predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    page.tiled = TILE_OFFSETS in tags
    if page.bits not in (8, 16) or any(b != page.bits for b in tags.get(BITS, ())):
        raise ValueError("only 8 and 16 bits a sample are supported")
    if page.predictor not in (1, 2):
        raise ValueError(f"predictor {page.predictor} is not supported")
    if page.samples > 1 and one(PLANAR, 1) != 1:
        raise ValueError("separate planes are not supported")
    kind = np.dtype("u1" if page.bits == 8 else order + "u2")
    if page.tiled:
        w, h = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)
        places, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        w, h = page.width, min(one(ROWS_PER_STRIP, page.height), page.height)
        places, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if not (page.width and page.height and w and h):
        raise ValueError("an image without pixels")
    across, down = -(-page.width // w), -(-page.height // h)
    if len(places) < across * down or len(sizes) < across * down:
        raise ValueError("strips or tiles are missing")
    page.n_chunks = across * down
    out = np.zeros((page.height, page.width, page.samples), kind)
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if page.tiled else min(h, page.height - y)
        size = rows * w * page.samples * kind.itemsize
        raw = _decoded(data[places[k] : places[k] + sizes[k]], page.compression, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        chunk = np.frombuffer(raw, kind, rows * w * page.samples).reshape(rows, w, page.samples)
        if page.predictor == 2:
            chunk = np.cumsum(chunk, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + rows, x : x + w] = chunk[: page.height - y, : page.width - x]
    page.mean = float(out.mean())
    page.pixels = out.tobytes()


def pages_of(data: bytes | None) -> Iterator[Page]:
    """A page for every image directory of ``data``, in order.

    A page that cannot be decoded has its error and no pixels, and the walk
    goes on; a file that is no TIFF, or whose chain breaks or returns to a
    directory, ends with a page that has only an error. Null gives nothing.
    """
    if data is None:
        return
    number, seen = 0, set()
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError
    except (KeyError, ValueError, struct.error):
        yield Page(0, error="not a TIFF file")
        return
    while at:
        page = Page(number)
        if at in seen:
            page.error = "the chain of directories returns"
            yield page
            return
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
        except struct.error:
            page.error = "a directory lies beyond the file"
            yield page
            return
        try:
            _image(data, tags, order, page)
        except (ValueError, KeyError, IndexError, zlib.error) as e:
            page.error = str(e) or type(e).__name__
        yield page
        number += 1


def tiff_pages(media: DataFrame, keys: tuple[str, ...], media_column: str, nested: bool = False) -> DataFrame:
    """One row per page of the TIFF files in ``media_column``: the ``keys`` and ``PAGE_FIELDS``.

    With ``nested``, one row per file with an array ``pages`` instead. Null
    media give no pages; broken files and pages give a row with ``error``.
    Keys may repeat or be null; other columns are left out.
    """
    fields = [f.split()[0] for f in PAGE_FIELDS.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            found = [[{f: getattr(p, f) for f in fields} for p in pages_of(m.as_py())] for m in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, PAGES_TYPE)], [*names, "pages"])

    # names of the keys must not clash with those of the fields while both are at hand
    names = [f"key_{i}" for i in range(len(keys))]
    kinds = ", ".join(f"{n} {media.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True))
    rows = media.select(*(F.col(f"`{k}`").alias(n) for n, k in zip(names, keys, strict=True)), F.col(f"`{media_column}`").alias("media"))
    out = rows.mapInArrow(of, f"{kinds}, pages array<struct<{_struct()}>>")
    own = [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    return out.select(*own, "pages") if nested else out.select(*own, F.inline("pages"))


def _struct() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in PAGE_FIELDS.split(", "))


_ARROW = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
PAGES_TYPE = pa.list_(pa.struct([(f.split()[0], _ARROW[f.split()[1]]) for f in PAGE_FIELDS.split(", ")]))


# ---- writing --------------------------------------------------------------


def encode_pages(images: list[np.ndarray], compression: int = NONE, predictor: int = 1, tile: int | None = None, rows_per_strip: int = 64) -> bytes:
    """A little-endian TIFF of 8-bit images (height x width, or height x width x samples)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        image = image.reshape(*image.shape[:2], -1)
        height, width, samples = image.shape
        chunks = []
        if tile:
            across, down = -(-width // tile), -(-height // tile)
            padded = np.zeros((down * tile, across * tile, samples), np.uint8)
            padded[:height, :width] = image
            chunks = [padded[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            chunks = [image[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for chunk in chunks:
            if predictor == 2:
                chunk = np.concatenate([chunk[:, :1], np.diff(chunk, axis=1)], axis=1)
            raw = np.ascontiguousarray(chunk).tobytes()
            raw = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda r: zlib.compress(r, 6)}[compression](raw)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        if tile:
            entries += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, places), (TILE_BYTES, 4, sizes)]
        else:
            entries += [(STRIP_OFFSETS, 4, places), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        fields = b""
        for tag, kind, values in sorted(entries):
            raw = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack("<I", place)
            fields += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAYLOAD_UNIT, PAGE_ROWS = 576, 64
#: The codecs that texts are stored with; LZW is the slowest to write.
STORED_AS = (NONE, DEFLATE, PACKBITS, DEFLATE, LZW, DEFLATE, PACKBITS, DEFLATE)


def payload_of(text: str | None) -> bytes:
    """The text as UTF-8, filled with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8")
    return raw + b"\xff" * (max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT - len(raw))


def stored_text(text: str | None) -> bytes:
    """A TIFF that holds ``payload_of(text)``: 576 samples a row, 64 rows a page.

    The codec, the predictor and strips or tiles follow from the payload's
    CRC-32, so that all kinds occur and equal texts are stored equally.
    """
    payload = payload_of(text)
    kind = zlib.crc32(payload)
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_UNIT)
    pages = [image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)]
    return encode_pages(pages, STORED_AS[kind % 8], 1 + kind // 8 % 2, 64 if kind // 16 % 2 else None, 16)


def stored_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every document's text stored as a TIFF file; a null text is empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len((t or "").encode("utf-8")) for t in texts], pa.int64()), pa.array(map(stored_text, texts), pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_bytes long, media binary")

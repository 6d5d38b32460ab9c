"""Progressive JPEG columns: scans accumulated into coefficient arrays, then pixels.

`decode` reads a progressive JPEG of 8-bit samples: it gathers its scans (spectral selection and
successive approximation, restart intervals, interleaved or not) into one integer array of coefficients
per component, dequantises, inverse-transforms all blocks with one matrix product, upsamples chroma and
gives a full-resolution RGB tensor.

`encode_payload` stores bytes without loss. A byte b is the coefficient b + 2, in the order of the zigzag;
192 bytes fill a block of each of three components. Scans: all first coefficients without their lowest bit,
that bit, then for each component two bands of the others without their lowest bit, then those bits.
No coefficient is zero, so no zero run occurs, and the Huffman tables give a category that is followed
by s bits a code of 9 - s bits: each coefficient of a first pass takes 9 bits, and each of a refinement
one. `fixed_width` finds that property in any file's tables, and such scans are read as arrays of bits
rather than symbol by symbol.

Defined results: a null or empty text is 192 spaces; equal texts give equal files and features; a text of
any length is split over rows of blocks; more input columns don't matter. Coefficients that a stream cuts
short stay as earlier scans left them.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches, text_or_empty

UNIT = 192
WIDE = 1024  # blocks in a row of a stored payload at most
RUN_BLOCKS = 32_767  # the longest end-of-band run
#: Fixed by the format: the place in an 8x8 block of each coefficient of a scan.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, (p // 8 if (p // 8 + p % 8) % 2 else p % 8))))
SOF2, DHT, SOI, EOI, SOS, DQT, DRI, COM = 0xC2, 0xC4, 0xD8, 0xD9, 0xDA, 0xDB, 0xDD, 0xFE


def transform() -> np.ndarray:
    """64 x 64: a row of coefficients times it is a row of samples."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.kron(one, one).astype(np.float32)


IDCT = transform()


def segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(data) + 2).to_bytes(2, "big") + data


# --- storing a payload ---------------------------------------------------------------------------

DC_SIZES = {s: 9 - s for s in range(1, 9)} | {0: 9}
AC_SIZES = {s: 9 - s for s in range(1, 9)}
#: Ends of bands: runs of 2**n blocks and more.
RUN_SYMBOLS = {n << 4: n + 1 for n in range(15)}


def codes(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, bits)."""
    out, code, last = {}, 0, 0
    for symbol, bits in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        code <<= bits - last
        out[symbol], last = (code, bits), bits
        code += 1
    return out


def table_segment(kind: int, number: int, sizes: dict[int, int]) -> bytes:
    order = sorted(sizes, key=lambda s: (sizes[s], s))
    return segment(DHT, bytes([kind << 4 | number]) + bytes(sum(v == k for v in sizes.values()) for k in range(1, 17)) + bytes(order))


TABLES = table_segment(0, 0, DC_SIZES) + table_segment(1, 0, AC_SIZES) + table_segment(1, 1, RUN_SYMBOLS)
RUN_CODES = codes(RUN_SYMBOLS)


def nine_bits(values: np.ndarray, sizes: dict[int, int]) -> np.ndarray:
    """Code and value bits of each value as 9-bit numbers."""
    lookup = np.zeros(511, np.uint16)
    for v in range(-255, 256):
        s = abs(v).bit_length()
        if s in sizes:
            code = codes(sizes)[s][0]
            lookup[v + 255] = code << s | (v if v > 0 else v + (1 << s) - 1)
    return lookup[values + 255]


DC_LOOKUP = nine_bits(np.arange(-255, 256), DC_SIZES)
AC_LOOKUP = nine_bits(np.arange(-255, 256), AC_SIZES)
SHIFTS = np.arange(8, -1, -1, dtype=np.uint16)


def spread(numbers: np.ndarray) -> bytes:
    """9-bit numbers as bytes, the last filled with ones; 8 numbers are 9 bytes, so pieces of them can follow each other."""
    parts = []
    for i in range(0, len(numbers), 1 << 18):
        bits = (numbers[i : i + (1 << 18), None] >> SHIFTS & 1).astype(np.uint8).reshape(-1)
        parts.append(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes())
    return b"".join(parts)


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def scan(components: list[int], start: int, end: int, high: int, low: int, tables: tuple[int, int], data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, tables[0] << 4 | tables[1]]) for c in components) + bytes([start, end, high << 4 | low])
    return segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds payload (whole units of 192 bytes)."""
    units = len(payload) // UNIT
    wide = min(units, WIDE)
    high = -(-units // wide)
    data = np.full(wide * high * UNIT, 32, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = data.reshape(-1, 3, 64).astype(np.int16) + 2
    upper, lowest = values >> 1, (values & 1).astype(np.uint8)
    out = [b"\xff\xd8", segment(COM, b"payload %d" % len(payload)), segment(DQT, b"\x00" + b"\x01" * 64)]
    out.append(segment(SOF2, b"\x08" + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + b"\x03" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))))
    out.append(TABLES)
    first = upper[:, :, 0]
    steps = np.diff(first, axis=0, prepend=np.zeros((1, 3), np.int16)).reshape(-1)
    out.append(scan([1, 2, 3], 0, 0, 0, 1, (0, 0), spread(DC_LOOKUP[steps + 255])))
    out.append(scan([1, 2, 3], 0, 0, 1, 0, (0, 0), packed(lowest[:, :, 0].reshape(-1))))
    for band in ((1, 5), (6, 63)):
        for c in range(3):
            out.append(scan([c + 1], *band, 0, 1, (0, 0), spread(AC_LOOKUP[upper[:, c, band[0] : band[1] + 1].reshape(-1) + 255])))
    for band in ((1, 5), (6, 63)):
        for c in range(3):
            bits = []
            for i in range(0, len(lowest), RUN_BLOCKS):
                own = lowest[i : i + RUN_BLOCKS, c, band[0] : band[1] + 1].reshape(-1)
                n = len(lowest[i : i + RUN_BLOCKS])
                size = n.bit_length() - 1
                code, length = RUN_CODES[size << 4]
                head = f"{code:0{length}b}" + (f"{n - (1 << size):0{size}b}" if size else "")
                bits += [np.array([*map(int, head)], np.uint8), own]
            out.append(scan([c + 1], *band, 1, 0, (0, 1), packed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: "Image") -> bytes:
    """The payload of a file that encode_payload made, from its coefficients."""
    size = int(image.comment.split()[1])
    values = np.stack([c[:, :].reshape(-1, 64) for c in image.coefficients], axis=1)
    return (values - 2).astype(np.uint8).tobytes()[:size]


# --- reading -------------------------------------------------------------------------------------


class Bits:
    """A scan's data bit by bit, restart markers taken out by the caller."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        if self.at + n > len(self.bits):
            raise EOFError
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Image:
    """size, coefficients (rows of blocks x columns x 64, zigzag order) and what is needed to make pixels of them."""

    def __init__(self):
        self.comment, self.quant, self.components, self.coefficients, self.restart = b"", {}, [], [], 0
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}


def fixed_width(table: dict[tuple[int, int], int]) -> int:
    """Bits of a code and the value after it where all symbols agree and no symbol has a zero run, else 0."""
    widths = {n + s for (n, _), s in table.items()}
    return widths.pop() if len(widths) == 1 and all(s < 16 for s in table.values()) else 0


@functools.lru_cache(64)
def value_table(table: tuple[tuple[tuple[int, int], int], ...], width: int) -> np.ndarray:
    """The value of each number of width bits."""
    out = np.zeros(1 << width, np.int32)
    for (n, code), s in table:
        v = np.arange(1 << s)
        out[(code << s) + v] = np.where(v >> max(s - 1, 0) > 0, v, v - (1 << s) + 1) if s else 0
    return out


def numbers(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n numbers of width bits."""
    out, weights, step = np.empty(n, np.int64), 1 << np.arange(width - 1, -1, -1), 1 << 18  # step x width is whole bytes
    for i in range(0, n, step):
        k = min(step, n - i)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=i * width // 8, count=-(-k * width // 8)), count=k * width)
        out[i : i + k] = bits.reshape(k, width).astype(np.float32) @ weights.astype(np.float32)
    return out


def decode_image(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated."""
    image, at = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        marker, at = data[at + 1], at + 2
        if marker == EOI:
            break
        size = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + size], at + size
        if marker == COM:
            image.comment = body
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == DRI:
            image.restart = int.from_bytes(body, "big")
        elif marker == DHT:
            while body:
                counts, symbols, table, code, k = body[1:17], body[17:], {}, 0, 0
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[n, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                image.tables[body[0] >> 4, body[0] & 15] = table
                body = body[17 + k :]
        elif marker == SOF2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image.h, image.v = max(c[1] for c in image.components), max(c[2] for c in image.components)
            image.mcus = -(-image.height // (8 * image.v)), -(-image.width // (8 * image.h))
            image.coefficients = [np.zeros((image.mcus[0] * c[2], image.mcus[1] * c[1], 64), np.int32) for c in image.components]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif marker == SOS:
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            read_scan(image, body, data[at:end])
            at = end
    return image


def read_scan(image: Image, head: bytes, data: bytes) -> None:
    n = head[0]
    names = [c[0] for c in image.components]
    parts = [(names.index(head[1 + 2 * i]), head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
    start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if not image.restart and whole_scan(image, parts, start, end, high, low, data):
        return
    pieces, at = [], 0
    for i in range(len(data) - 1):  # restart markers
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            pieces.append(data[at:i])
            at = i + 2
    pieces.append(data[at:])
    blocks = scan_blocks(image, [p[0] for p in parts])
    every = image.restart or len(blocks)
    by = {p[0]: p for p in parts}
    for k, piece in enumerate(pieces):
        bits, before, run = Bits(piece.replace(b"\xff\x00", b"\xff")), dict.fromkeys(by, 0), 0
        try:
            for unit in blocks[k * every : (k + 1) * every]:
                for c, row, column in unit:
                    block = image.coefficients[c][row, column]
                    if start == 0:
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            before[c] += bits.signed(bits.symbol(image.tables[0, by[c][1]]))
                            block[0] = before[c] << low
                    elif high:
                        run = refine_band(block, bits, image.tables[1, by[c][2]], start, end, low, run)
                    else:
                        run = first_band(block, bits, image.tables[1, by[c][2]], start, end, low, run)
        except EOFError:
            continue


def scan_blocks(image: Image, components: list[int]) -> list[list[tuple[int, int, int]]]:
    """The blocks of each unit of a scan in order."""
    if len(components) == 1:
        c = components[0]
        _, h, v, _ = image.components[c]
        rows, columns = -(-(-(-image.height * v // image.v)) // 8), -(-(-(-image.width * h // image.h)) // 8)
        return [[(c, r, k)] for r in range(rows) for k in range(columns)]
    return [
        [(c, r * image.components[c][2] + y, k * image.components[c][1] + x) for c in components for y in range(image.components[c][2]) for x in range(image.components[c][1])]
        for r in range(image.mcus[0])
        for k in range(image.mcus[1])
    ]


def first_band(block, bits, table, start, end, low, run):
    if run:
        return run - 1
    k = start
    while k <= end:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if s:
            k += r
            block[k] = bits.signed(s) << low if s else 0
            k += 1
        elif r < 15:
            return (1 << r) - 1 + bits.take(r)
        else:
            k += 16
    return 0


def refine_band(block, bits, table, start, end, low, run):
    """Successive approximation: one more bit for each coefficient that is known, and new ones of size 1."""
    one, k = 1 << low, start

    def known(i):
        if bits.take(1):
            block[i] += one if block[i] > 0 else -one

    if not run:
        while k <= end:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (one if bits.take(1) else -one) if s else 0
            while k <= end:
                if block[k]:
                    known(k)
                elif r:
                    r -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
    if run:
        for i in range(k, end + 1):
            if block[i]:
                known(i)
        run -= 1
    return run


def whole_scan(image: Image, parts, start: int, end: int, high: int, low: int, data: bytes) -> bool:
    """Reads a scan as arrays where its coefficients all have one width; False where they don't."""
    plain = all(c[1:3] == (1, 1) for c in image.components)
    exact = plain and image.height % 8 == 0 and image.width % 8 == 0
    if not exact or (start and len(parts) > 1):
        return False
    arrays = [image.coefficients[p[0]].reshape(-1, 64) for p in parts]
    blocks = len(arrays[0])
    data = data.replace(b"\xff\x00", b"\xff")
    if not high:
        tables = [image.tables[(1, p[2]) if start else (0, p[1])] for p in parts]
        width = fixed_width(tables[0])
        count = blocks * (len(parts) if not start else end - start + 1)
        if not 0 < width <= 16 or any(t is not tables[0] for t in tables) or len(data) * 8 < count * width or (start and 0 in tables[0].values()):
            return False
        values = value_table(tuple(tables[0].items()), width)[numbers(data, count, width)]
        if start:
            arrays[0][:, start : end + 1] = values.reshape(blocks, -1) << low
        else:
            for i, a in enumerate(arrays):
                a[:, 0] = np.cumsum(values.reshape(blocks, -1)[:, i]) << low
        return True
    if not start:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        if len(bits) < blocks * len(parts):
            return False
        for i, a in enumerate(arrays):
            a[:, 0] |= bits[: blocks * len(parts)].reshape(blocks, -1)[:, i].astype(np.int32) << low
        return True
    band = arrays[0][:, start : end + 1]
    if not band.all():
        return False
    # nothing is new: the bits of known coefficients follow the codes of runs to the end of the band
    bits, at, row, table = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0, image.tables[1, parts[0][2]]
    width, taken = end - start + 1, []
    while row < blocks:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(bits[at])
            at += 1
            if (n, code) in table:
                break
        else:
            return False
        r, s = divmod(table[n, code], 16)
        if s or r == 15:
            return False
        run = (1 << r) + int("".join(map(str, bits[at : at + r])) or "0", 2)
        at += r
        run = min(run, blocks - row)
        if at + run * width > len(bits):
            return False
        taken.append(bits[at : at + run * width])
        at, row = at + run * width, row + run
    step = np.concatenate(taken).reshape(blocks, width).astype(np.int32) << low
    band += np.where(band > 0, step, -step)
    return True


def pixels(image: Image) -> np.ndarray:
    """height x width x 3 (or 1) of 8 bits: inverse transform of all blocks, chroma at full resolution, RGB."""
    planes = []
    for (_, h, v, q), coefficients in zip(image.components, image.coefficients):
        rows, columns, _ = coefficients.shape
        natural = np.zeros((rows * columns, 64), np.float32)
        natural[:, ZIGZAG] = coefficients.reshape(-1, 64) * image.quant[q]
        samples = natural @ IDCT + 128
        plane = samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        plane = np.repeat(np.repeat(plane, image.v // v, axis=0), image.h // h, axis=1)
        planes.append(np.clip(np.rint(plane[: image.height, : image.width]), 0, 255))
    if len(planes) == 1:
        return planes[0].astype(np.uint8)[:, :, None]
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return pixels(decode_image(data))


def feature(image: Image) -> str:
    """Width, height, the mean of each channel and of the neighbours' difference in a row, in hundredths."""
    rgb = pixels(image)
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(rgb[:, :, c].sum(dtype=np.int64)) * 100 // n for c in range(rgb.shape[2])]
    grey = rgb.sum(axis=2, dtype=np.int32)
    edge = int(np.abs(np.diff(grey, axis=1)).sum(dtype=np.int64)) * 100 // n
    return f"{image.width}x{image.height};{','.join(map(str, means))};{edge}"


def stored(text: bytes) -> dict:
    """Stores a text, reads the stored bytes back and says what came back."""
    payload = text + b" " * ((-len(text) % UNIT) or (0 if text else UNIT))
    media = encode_payload(payload)
    image = decode_image(media)
    back = payload_of(image)
    return {
        "n_bytes": len(text),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-16:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature(image),
    }


RESULT = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def store_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a progressive JPEG and read back; with keep_media also its bytes."""

    def run(batches):
        for batch in batches:
            out = [stored(x.encode()) for x in batch.column(1).to_pylist()]
            columns = [pa.array([r[f.name] for r in out], f.type) for f in RESULT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *RESULT.names])

    def run_media(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                media = encode_payload(raw + b" " * ((-len(raw) % UNIT) or (0 if raw else UNIT)))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], batch.schema.field(0).type), pa.array([media], pa.binary())], ["id", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    if keep_media:
        return rows.transform(in_batches, run_media, f"id {kind}, media binary").withColumnRenamed("id", id_column)
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.transform(in_batches, run, schema).withColumnRenamed("id", id_column)


def rgb_tensors(media: DataFrame, *, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """id, height, width, channels and the RGB tensor's bytes of a column of progressive JPEGs; nulls for a null or a file of another kind."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, data = batch.column(0)[row], batch.column(1)[row].as_py()
                try:
                    t = decode(data) if data is not None else None
                except (ValueError, KeyError, IndexError):
                    t = None
                shape = t.shape if t is not None else (None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], doc_id.type), *(pa.array([x], pa.int32()) for x in shape), pa.array([None if t is None else t.tobytes()], pa.binary())], ["id", "height", "width", "channels", "rgb"])

    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media")).transform(in_batches, run, f"id {kind}, height int, width int, channels int, rgb binary").withColumnRenamed("id", id_column)

"""Compressed pixels of DICOM files: run lengths of byte planes, and lossless JPEG."""

from __future__ import annotations

import struct

import numpy as np

# Markers of a JPEG stream.
_SOI, _EOI, _SOS, _DHT, _SOF3, _DRI = 0xD8, 0xD9, 0xDA, 0xC4, 0xC3, 0xDD


def unpacked(data: bytes) -> bytes:
    """Run lengths undone: n < 128 is followed by n + 1 bytes as they are, n > 128 by one byte that comes 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packed(data: bytes) -> bytes:
    """Run lengths of three and more equal bytes, other bytes as they are."""
    values = np.frombuffer(data, np.uint8)
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else values
    out, plain = bytearray(), bytearray()

    def literal() -> None:
        for lo in range(0, len(plain), 128):
            part = plain[lo : lo + 128]
            out.extend(bytes([len(part) - 1]) + part)
        plain.clear()

    for a, b in zip(begin, np.append(begin, len(values))[1:], strict=True):
        n = int(b - a)
        if n < 3:
            plain.extend(data[a:b])
            continue
        literal()
        for lo in range(0, n, 128):
            times = min(n - lo, 128)
            out.extend((bytes([257 - times]) if times > 1 else b"\0") + data[a : a + 1])
    literal()
    return bytes(out) + b"\x80" * (len(out) % 2)


def rle_values(data: bytes, rows: int, columns: int, size: int) -> np.ndarray:
    """Values of ``size`` bytes, as unsigned numbers: a segment for each byte, the most significant first."""
    count, *offsets = struct.unpack_from("<16I", data)
    if count != size:
        raise ValueError(f"{count} run-length segments for values of {size} bytes")
    ends = [*offsets[1:count], len(data)]
    planes = []
    for a, b in zip(offsets[:count], ends, strict=True):
        plane = np.frombuffer(unpacked(data[a:b]), np.uint8)
        if len(plane) < rows * columns:
            raise ValueError("a run-length segment ends early")
        planes.append(plane[: rows * columns])
    return np.stack(planes[::-1], 1).copy().view(f"<u{size}").reshape(rows, columns)


def rle_bytes(values: np.ndarray) -> bytes:
    """The segments of unsigned values, with their header."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values).astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, size)
    parts = [packed(planes[:, k].tobytes()) for k in range(size - 1, -1, -1)]
    offsets = np.append(64, 64 + np.cumsum([len(p) for p in parts]))[:size].tolist()
    return struct.pack("<16I", size, *offsets, *[0] * (15 - size)) + b"".join(parts)


def _codes(counts: bytes) -> list[tuple[int, int]]:
    """(code, length) in order of a canonical table with so many codes of 1, 2 .. 16 bits."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _differences(data: bytes, counts: bytes, symbols: bytes, n: int) -> np.ndarray:
    """n differences of a stretch of codes.

    What code each bit would begin is looked up for all bits at once; then only the chain
    of codes is followed one by one.
    """
    length, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (code, bits), symbol in zip(_codes(counts), symbols, strict=True):
        span = slice(code << 16 - bits, code + 1 << 16 - bits)
        length[span], size[span] = bits, symbol
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    window = np.stack([three >> 8 - k & 0xFFFF for k in range(8)], 1).ravel()
    extra = np.where(size[window] == 16, 0, size[window])
    step = np.where(length[window] > 0, length[window] + extra, len(window))
    on = (np.arange(len(window)) + step).tolist()
    at, p = [], 0
    for _ in range(n):
        if p >= len(on):
            raise ValueError("the compressed pixels end early")
        at.append(p)
        p = on[p]
    if p > len(window):
        raise ValueError("a code of the compressed pixels isn't known")
    at = np.array(at, np.int64)
    bits, more = size[window[at]], extra[at]
    value = window[np.minimum(at + length[window[at]], len(window) - 1)] >> 16 - more
    low = (more > 0) & (value < 1 << np.maximum(more - 1, 0))
    return np.where(bits == 16, 1 << 15, np.where(low, value - (1 << more) + 1, np.where(more > 0, value, 0)))


def _predicted(difference: np.ndarray, predictor: int, first: int) -> np.ndarray:
    """Values from differences, modulo 2 ** 16; the first row is predicted from the left, the first column from above."""
    d = difference.copy()
    d[0, 0] += first
    d[0] = np.cumsum(d[0])
    if predictor in (1, 2):
        if predictor == 2:
            return np.cumsum(d, 0) & 0xFFFF
        d[:, 0] = np.cumsum(d[:, 0])
        d[1:] = np.cumsum(d[1:], 1)
        return d & 0xFFFF
    out = d & 0xFFFF
    for y in range(1, len(out)):
        above = out[y - 1].tolist()
        row, left = [], above[0]
        for x, e in enumerate(d[y].tolist()):
            a, b, c = left, above[x], above[x - 1]
            if x == 0:
                p = b
            elif predictor == 3:
                p = c
            elif predictor == 4:
                p = a + b - c
            elif predictor == 5:
                p = a + (b - c >> 1)
            elif predictor == 6:
                p = b + (a - c >> 1)
            else:
                p = a + b >> 1
            left = p + e & 0xFFFF
            row.append(left)
        out[y] = row
    return out


def jpeg_values(data: bytes) -> np.ndarray:
    """Unsigned values of a lossless JPEG stream of one component, with any of the seven predictors."""
    if data[:2] != bytes([0xFF, _SOI]):
        raise ValueError("no JPEG stream")
    at, tables, frame, interval = 2, {}, None, 0
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == _DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == _SOF3:
            frame = struct.unpack_from(">BHHB", body)
        elif marker == _DRI:
            interval = struct.unpack_from(">H", body)[0]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only lossless JPEG of sequential codes is read")
        elif marker == _SOS:
            break
    if frame is None or frame[3] != 1 or body[0] != 1:
        raise ValueError("a lossless JPEG stream of one component is needed")
    precision, rows, columns, _ = frame
    table, predictor, shift = tables[body[2] >> 4], body[3], body[5] & 15
    if not 1 <= predictor <= 7 or interval % max(columns, 1):
        raise ValueError(f"predictor {predictor} or a restart within a row isn't read")
    parts, begin, i = [], at, at
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        if 0xD0 <= data[i + 1] <= 0xD7 or data[i + 1] == _EOI:
            parts.append(data[begin:i])
            begin = i + 2
            if data[i + 1] == _EOI:
                break
        i += 2
    else:
        parts.append(data[begin:])
    lines = interval // columns or rows
    out = []
    for k, lo in enumerate(range(0, rows, lines)):
        n = min(lines, rows - lo)
        d = _differences(parts[k] if k < len(parts) else b"", *table, n * columns).reshape(n, columns)
        out.append(_predicted(d, predictor, 1 << precision - shift - 1))
    return (np.concatenate(out) << shift & 0xFFFF).astype(np.uint16)


def jpeg_bytes(values: np.ndarray, predictor: int = 1, restart: int = 0) -> bytes:
    """A lossless JPEG stream of unsigned 16-bit values; ``restart`` rows begin anew."""
    rows, columns = values.shape
    v = values.astype(np.int64)
    lines = restart or rows
    out = []
    for lo in range(0, rows, lines):
        part = v[lo : lo + lines]
        left, above, corner = np.roll(part, 1, 1), np.roll(part, 1, 0), np.roll(np.roll(part, 1, 0), 1, 1)
        p = {1: left, 2: above, 3: corner, 4: left + above - corner, 5: left + (above - corner >> 1), 6: above + (left - corner >> 1), 7: left + above >> 1}[predictor].copy()
        p[0], p[:, 0] = left[0], above[:, 0]
        p[0, 0] = 1 << 15
        d = ((part - p + (1 << 15)) & 0xFFFF) - (1 << 15)
        bits = []
        for e in d.ravel().tolist():
            size = 16 if e == -(1 << 15) else abs(e).bit_length()
            bits.append(f"{size:05b}" + (f"{e if e > 0 else e + (1 << size) - 1:0{size}b}" if 0 < size < 16 else ""))
        stream = "".join(bits)
        stream += "1" * (-len(stream) % 8)
        out.append(int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00"))
    body = b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(out) else b"") for k, p in enumerate(out))
    segment = lambda marker, content: bytes([0xFF, marker]) + struct.pack(">H", len(content) + 2) + content
    # All 17 sizes have codes of five bits.
    table = segment(_DHT, bytes([0]) + bytes([0, 0, 0, 0, 17, *[0] * 11]) + bytes(range(17)))
    head = segment(_SOF3, struct.pack(">BHHB", 16, rows, columns, 1) + bytes([1, 0x11, 0]))
    again = segment(_DRI, struct.pack(">H", restart * columns)) if restart else b""
    return bytes([0xFF, _SOI]) + table + head + again + segment(_SOS, bytes([1, 1, 0, predictor, 0, 0])) + body + bytes([0xFF, _EOI])

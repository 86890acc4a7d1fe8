"""Baseline JPEG files without chroma subsampling, written with numpy (ITU-T T.81, sequential DCT).

Blocks are transformed and quantised together; Huffman codes are made for each image from its own symbols.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The example quantisation tables of T.81, Annex K, for luma and chroma, in rows.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)

#: Places of a block in the order in which they are written: along anti-diagonals, to and fro.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_K = np.arange(8)
_DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))
#: RGB to luma and the two chroma differences, as JFIF has them.
_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def scaled(table, quality: int) -> np.ndarray:
    """A quantisation table for a quality of 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most 16 bits for symbols with a count, no code all ones."""
    heap = [(int(n), int(s), [int(s)]) for s, n in enumerate(counts) if n] + [(0, 256, [256])]  # the last one keeps a code free
    size = np.zeros(257, np.int64)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        size[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    bits = np.bincount(size[size > 0], minlength=64)
    for i in range(len(bits) - 1, 16, -1):  # pairs of codes that are too long move up
        while bits[i] > 0:
            j = i - 2
            while bits[j] == 0:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    order = sorted((s for s in range(257) if size[s]), key=lambda s: (size[s], s == 256, s))
    out = np.zeros(257, np.int64)
    out[order] = np.repeat(np.arange(len(bits)), bits)
    return out


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as the file holds it."""
    size = code_lengths(counts)
    if size[256] != size.max():  # the free code is one of the longest
        other = int(np.flatnonzero(size == size.max())[-1])
        size[256], size[other] = size[other], size[256]
    order = sorted((s for s in range(256) if size[s]), key=lambda s: (size[s], s))
    codes, code, last = np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= int(size[s]) - last
        codes[s], last = code, int(size[s])
        code += 1
    per = np.bincount(size[:256][size[:256] > 0], minlength=17)[1:17]
    return codes, size[:256], bytes(per.tolist()) + bytes(order)


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits a value takes, and those bits."""
    n = np.zeros(v.shape, np.int64)
    n[v != 0] = np.floor(np.log2(np.abs(v[v != 0]))).astype(np.int64) + 1
    return n, np.where(v < 0, v + (1 << n) - 1, v)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks (n, 64) in zigzag order the symbols: block, whether it is a first coefficient, symbol, extra bits and how many."""
    n = len(blocks)
    first = np.diff(blocks[:, 0], prepend=0)
    size, extra = _magnitude(first)
    rows = [(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), size, extra, size)]
    at, place = np.nonzero(blocks[:, 1:])
    place = place + 1
    value = blocks[at, place]
    same = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.empty(0, bool)
    run = place - np.where(same, np.concatenate([[0], place[:-1]]), 0) - 1
    size, extra = _magnitude(value)
    rows.append((at, place, np.full(len(at), 2), (run % 16) << 4 | size, extra, size))
    longest = run // 16
    for k in range(1, 4):  # each stands for sixteen zeros
        w = np.flatnonzero(longest >= k)
        rows.append((at[w], place[w], np.ones(len(w), np.int64), np.full(len(w), 0xF0), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)))
    last = np.zeros(n, np.int64)
    np.maximum.at(last, at, place)
    w = np.flatnonzero(last < 63)
    rows.append((w, np.full(len(w), 64), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)))
    block, place, rank, symbol, extra, bits = (np.concatenate(c) for c in zip(*rows, strict=True))
    order = np.lexsort((rank, place, block))
    return block[order], place[order] == 0, symbol[order], extra[order], bits[order]


def _packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """Values as so many bits each, one after the other, with a zero byte after each byte of ones."""
    keep = bits > 0
    values, bits = values[keep], bits[keep]
    owner = np.repeat(np.arange(len(bits)), bits)
    down = np.repeat(np.cumsum(bits), bits) - np.arange(len(owner)) - 1
    flat = (values[owner] >> down & 1).astype(np.uint8)
    flat = np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)])
    return np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, data: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")


def profiled(data: bytes, icc: bytes) -> bytes:
    """A file of ``jpeg`` with a colour profile after its head."""
    parts = [icc[at : at + 65000] for at in range(0, len(icc), 65000)]
    told = b"".join(_segment(0xE2, b"ICC_PROFILE\0" + bytes([k, len(parts)]) + part) for k, part in enumerate(parts, 1))
    return data[: len(_HEAD)] + told + data[len(_HEAD) :]


def jpeg(pixels: np.ndarray, quality: int = 85, icc: bytes = b"") -> bytes:
    """A file of an array (height, width, 3) of uint8, with a colour profile if one is given."""
    h, w, _ = pixels.shape
    wide = np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge").astype(np.float64)
    planes = wide @ _YCC.T
    planes[..., 0] -= 128
    rows, columns = wide.shape[0] // 8, wide.shape[1] // 8
    tables = [scaled(LUMA, quality), scaled(CHROMA, quality)]
    parts, kinds = [], []
    for c in range(3):
        blocks = planes[..., c].reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        flat = (_DCT @ blocks @ _DCT.T).reshape(-1, 64) / tables[c > 0]
        q = np.where(flat < 0, -np.floor(-flat + 0.5), np.floor(flat + 0.5)).astype(np.int64)[:, ZIGZAG]
        q[:, 1:] = np.clip(q[:, 1:], -1023, 1023)
        parts.append(_symbols(q))
        kinds.append(np.where(parts[-1][1], 0, 1) + 2 * (c > 0))
    block, _, symbol, extra, bits = (np.concatenate([p[i] for p in parts]) for i in range(5))
    kind, plane = np.concatenate(kinds), np.repeat(np.arange(3), [len(k) for k in kinds])
    order = np.lexsort((np.arange(len(block)), plane, block))
    symbol, extra, bits, kind = symbol[order], extra[order], bits[order], kind[order]
    codes, sizes, segments = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), b""
    segment = _segment
    for k in range(4):
        of = kind == k
        code, size, table = huffman(np.bincount(symbol[of], minlength=256))
        codes[of], sizes[of] = code[symbol[of]], size[symbol[of]]
        segments += segment(0xC4, bytes([(k % 2) << 4 | k // 2]) + table)
    values, lengths = np.stack([codes, extra], 1).ravel(), np.stack([sizes, bits], 1).ravel()
    out = _HEAD
    for i, t in enumerate(tables):
        out += segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\1\x11\0\2\x11\1\3\x11\1") + segments
    return profiled(out + segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + _packed(values, lengths) + b"\xff\xd9", icc)

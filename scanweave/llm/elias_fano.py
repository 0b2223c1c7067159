"""Elias-Fano sequences and files of them that are mapped into memory, for many lookups at a time.

A sequence that never falls is kept as its low bits, packed, and its high bits in unary: under two bits for each value more
than the low ones. Access and successor search run over whole arrays of questions.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs

_BLOCK = 8  # words of 64 bits for each entry of the directory
#: For each byte and k: the place of its k-th set bit.
_IN_BYTE = np.full((256, 8), 255, np.uint8)
for _b in range(256):
    _places = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, :len(_places)] = _places


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, and eight spare bytes."""
    parts = []
    for a in range(0, len(values) if width else 0, 1 << 18):
        some = np.ascontiguousarray(values[a:a + (1 << 18)], "<u8")
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits.ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def _unpack(packed: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(places), np.uint64)
    bit = places.astype(np.int64) * width
    rows = np.lib.stride_tricks.as_strided(packed, (len(packed) - 7, 8), (1, 1))[bit >> 3]
    return (rows.view("<u8").ravel() >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """``low``, ``high`` and ``ones`` (set bits before each block) of n values."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * _BLOCK) - ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        upper = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(-(-(n + (top >> width) + 2) // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64 * _BLOCK).sum(axis=1, dtype=np.int64))])[:-1]
        return cls(n, width, _pack(values, width), high, ones)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th set (or unset) bits."""
        heads = self.ones if one else self.zeros
        block = np.searchsorted(heads, k, "right") - 1
        rest, word = k - heads[block], block * _BLOCK
        for _ in range(_BLOCK - 1):
            n = np.bitwise_count(self.high[word]).astype(np.int64)
            n = n if one else 64 - n
            on = rest >= n
            if not on.any():
                break
            rest, word = np.where(on, rest - n, rest), word + on
        value = self.high[word] if one else ~self.high[word]
        place, octets = word * 64, np.ascontiguousarray(value, "<u8").view(np.uint8).reshape(-1, 8)
        byte = np.zeros(len(k), np.int64)
        at = np.arange(len(k))
        for _ in range(7):
            n = np.bitwise_count(octets[at, byte]).astype(np.int64)
            on = rest >= n
            if not on.any():
                break
            rest, byte = np.where(on, rest - n, rest), byte + on
        return place + byte * 8 + _IN_BYTE[octets[at, byte], rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.uint64)
        upper = (self._select(i, True) - i).astype(np.uint64)
        return upper << np.uint64(self.width) | _unpack(self.low, i, self.width)

    def all(self) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(self.high, "<u8").view(np.uint8), bitorder="little")
        upper = (np.flatnonzero(bits) - np.arange(self.n)).astype(np.uint64)
        return upper << np.uint64(self.width) | _unpack(self.low, np.arange(self.n), self.width)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of the first value not below x, n where there is none; with ``first`` and ``last``, looked for from
        place first up to and without last, which is the answer where there is none."""
        x = np.asarray(x, np.uint64)
        if not len(x):
            return np.empty(0, np.int64)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        most = self.zeros[-1] + int(64 * _BLOCK - np.bitwise_count(self.high[-_BLOCK:]).sum()) - 1
        inside = np.minimum(bucket, most)
        high = np.where(bucket > most, self.n, np.minimum(self._select(inside, False) - inside, self.n))
        low = np.where(inside > 0, self._select(np.maximum(inside - 1, 0), False) - np.maximum(inside - 1, 0), 0)
        low = np.where(bucket > most, self.n, np.minimum(low, self.n))
        if first is not None:
            low, high = np.clip(low, first, last), np.clip(high, first, last)
        want = x & np.uint64((1 << self.width) - 1)
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            less = _unpack(self.low, mid, self.width) < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        return low

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.width], np.int64)
        return {f"{name}.head": head, f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def within(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}.head"].tolist()
        return cls(n, width, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: the length of a JSON directory, the directory, the arrays at multiples of eight bytes."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (a.dtype.str, at, a.nbytes)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-len(head) % 8)
    out = [len(head).to_bytes(8, "little"), head]
    for a in arrays.values():
        out += [np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(out)


def from_bytes(buffer) -> dict[str, np.ndarray]:
    """The arrays of ``to_bytes``, in place."""
    whole = np.frombuffer(buffer, np.uint8)
    start = 8 + int(whole[:8].view("<u8")[0])
    places = json.loads(whole[8:start].tobytes())
    return {k: whole[start + at:start + at + size].view(kind) for k, (kind, at, size) in places.items()}


class Folder:
    """Files in a folder that driver and executors share: mapped into memory on a mounted disk, read whole elsewhere."""

    def __init__(self, uri: str):
        self.uri = uri

    def _place(self):
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (fs.LocalFileSystem(), self.uri)

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Whole or not at all, so a task that runs twice does no harm."""
        system, base = self._place()
        system.create_dir(base, recursive=True)
        own = f"{base}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(own) as f:
            f.write(to_bytes(arrays))
        system.move(own, f"{base}/{name}")

    def read(self, name: str) -> dict[str, np.ndarray]:
        system, base = self._place()
        if isinstance(system, fs.LocalFileSystem):
            return from_bytes(pa.memory_map(f"{base}/{name}").read_buffer())
        with system.open_input_file(f"{base}/{name}") as f:
            return from_bytes(f.read())

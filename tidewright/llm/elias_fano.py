"""Elias-Fano sequences and the compact files that hold them.

A sorted sequence keeps the low bits of each value packed, and the high bits as a bit vector with one 1 for each value
behind as many 0s as its high part. Queries take sorted arrays. All arrays are read in place from one memory-mapped file.
"""

from __future__ import annotations

import functools
import json
import os
import uuid

import numpy as np

U64 = np.uint64


_ONES, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
#: The place of the k-th 1 of every byte, at byte * 8 + k.
_IN_BYTE = np.array([([j for j in range(8) if byte >> j & 1] + [0] * 8)[:8] for byte in range(256)], np.int64).ravel()


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th 1 (from 0) in each word: running counts of all bytes at once, then a table for one byte."""
    k = k.astype(U64)
    s = words - ((words >> U64(1)) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
    s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    byte = np.bitwise_count((((k * _ONES) | _TOPS) - s) & _TOPS).astype(U64) << U64(3)
    rest = k - (((s << U64(8)) >> byte) & U64(255))
    return byte.astype(np.int64) + _IN_BYTE[((((words >> byte) & U64(255)) << U64(3)) + rest).astype(np.int64)]


class EliasFano:
    """Values in order; parts: n, low_bits, low, high, ones (1s before each word of high)."""

    def __init__(self, parts: dict):
        self.n, self.bits = int(parts["n"]), int(parts["low_bits"])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]

    @staticmethod
    def parts(values: np.ndarray) -> dict:
        """values: sorted uint64."""
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            own = values & U64((1 << bits) - 1)
            np.bitwise_or.at(low, at >> 6, own << (at & 63).astype(U64))
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, own[over] >> (64 - (at[over] & 63)).astype(U64))
        place = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((top >> bits) + n + 65) // 64 * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        return {"n": n, "low_bits": bits, "low": low, "high": high, "ones": ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U64)
        spill = np.where(shift == 0, U64(0), self.low[word + 1] << ((U64(64) - shift) & U64(63)))
        return ((self.low[word] >> shift) | spill) & U64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((place - i).astype(U64) << U64(self.bits)) | self._low(i)

    def values(self) -> np.ndarray:
        """All values."""
        high = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((high - i).astype(U64) << U64(self.bits)) | self._low(i)

    def range(self, a: int, b: int) -> np.ndarray:
        """The values at places a up to b."""
        return self.get(np.arange(a, b)) if b > a else np.empty(0, U64)

    @functools.cached_property
    def _zeros(self) -> np.ndarray:
        """0s before each word of high."""
        return np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place in high of the k-th 0; its end where there are fewer."""
        out = np.full(len(k), len(self.high) * 64, np.int64)
        inside = k < self._zeros[-1]
        k = k[inside] if not inside.all() else k
        word = np.searchsorted(self._zeros, k, "right") - 1
        out[inside] = word * 64 + _select(~self.high[word], k - self._zeros[word])
        return out

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the values with high part h: they begin behind the 0 before them and run as far as the 1s do."""
        place = np.zeros(len(h), np.int64)
        later = np.flatnonzero(h > 0)
        place[later] = self._zero(h[later] - 1) + 1
        start = np.minimum(place - h, self.n)
        word = np.minimum(place >> 6, len(self.high) - 1)
        shift = (place & 63).astype(U64)
        rest = ~(self.high[word] >> shift)
        run = np.bitwise_count((rest & -rest) - U64(1)).astype(np.int64)
        end = start + run
        open_ = np.flatnonzero(run + (place & 63) >= 64)  # the 1s go on in the next word
        end[open_] = self._zero(h[open_]) - h[open_]
        return start, np.minimum(end, self.n)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value by successor search among those with its high part; -1 if it is missing."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        h = np.minimum(values >> U64(self.bits), U64(1 << 62)).astype(np.int64)
        at, end = self._bucket(h)
        wanted = values & U64((1 << self.bits) - 1)
        # Values crowd where a context has many successors, so a high part's low bits are halved, not walked.
        last, live = end.copy(), np.flatnonzero(at < end)
        while len(live):
            a, b = at[live], end[live]
            middle = (a + b) >> 1
            less = self._low(middle) < wanted[live]
            at[live] = np.where(less, middle + 1, a)
            end[live] = np.where(less, b, middle)
            live = live[at[live] < end[live]]
        out = np.full(len(values), -1, np.int64)
        there = np.flatnonzero(at < last)
        there = there[self._low(at[there]) == wanted[there]]
        out[there] = at[there]
        return out


def to_bytes(arrays: dict[str, np.ndarray | int]) -> bytes:
    """All arrays with their names, each at a multiple of 8 bytes."""
    head, at, body = {}, 0, []
    for name, x in arrays.items():
        x = np.atleast_1d(np.asarray(x))
        head[name] = (x.dtype.str, at, len(x))
        body += [x.tobytes(), b"\0" * (-x.nbytes % 8)]
        at += x.nbytes + -x.nbytes % 8
    text = json.dumps(head, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *body])


def from_bytes(data: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays in a buffer of bytes, in place."""
    size = int(data[:8].view(np.int64)[0])
    out = {}
    for name, (kind, start, n) in json.loads(bytes(data[8 : 8 + size])).items():
        kind = np.dtype(kind)
        out[name] = data[8 + size + start : 8 + size + start + n * kind.itemsize].view(kind)
    return out


def prefixed(name: str, values: np.ndarray) -> dict:
    return {f"{name}_{k}": x for k, x in EliasFano.parts(values).items()}


def sequence(arrays: dict, name: str) -> EliasFano:
    return EliasFano({k: arrays[f"{name}_{k}"][0] if k in ("n", "low_bits") else arrays[f"{name}_{k}"] for k in ("n", "low_bits", "low", "high", "ones")})


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else os.path.abspath(path))


def write_file(path: str, arrays: dict[str, np.ndarray | int]) -> None:
    """All arrays in one file that appears at once, so that a repeated task does no harm."""
    system, to = _system(path)
    system.create_dir(os.path.dirname(to), recursive=True)
    own = f"{to}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(to_bytes(arrays))
    system.move(own, to)


@functools.lru_cache(maxsize=4096)
def read_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the shared folder is mounted, else from a copy beside the executor."""
    from pyarrow import fs

    system, at = _system(path)
    if not isinstance(system, fs.LocalFileSystem):
        from pyspark import SparkFiles

        local = os.path.join(SparkFiles.getRootDirectory(), f"{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}.level")
        if not os.path.exists(local):
            own = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(at, own, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            os.replace(own, local)
        at = local
    return from_bytes(np.memmap(at, np.uint8, "r").view(np.ndarray))

"""Elias-Fano sequences over numpy arrays, and files of arrays that tasks map into memory."""

from __future__ import annotations

import json
import mmap

import numpy as np

U = np.uint64
ONE = U(1)
#: Place of the k-th set bit of each byte.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, then where each is, then how long that list is."""
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    where, at = {}, 0
    with fs.open_output_stream(path) as out:
        for name, x in arrays.items():
            data = np.ascontiguousarray(x).tobytes()
            where[name] = [at, len(x), x.dtype.str]
            out.write(data + bytes(-len(data) % 8))
            at += len(data) + -len(data) % 8
        said = json.dumps(where).encode()
        out.write(said + len(said).to_bytes(8, "little"))


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file; mapped, not read, where the shared folder is mounted."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, path = FileSystem.from_uri(uri)
    if isinstance(fs, LocalFileSystem):
        with open(path, "rb") as file:  # all pages at once, not one by one as look-ups come to them
            data = np.frombuffer(mmap.mmap(file.fileno(), 0, mmap.MAP_SHARED | getattr(mmap, "MAP_POPULATE", 0), mmap.PROT_READ), np.uint8)
    else:
        data = np.frombuffer(fs.open_input_file(path).readall(), np.uint8)
    n = int.from_bytes(data[-8:].tobytes(), "little")
    where = json.loads(data[-8 - n : -8].tobytes())
    return {name: data[at : at + size * np.dtype(kind).itemsize].view(kind) for name, (at, size, kind) in where.items()}


class EliasFano:
    """A sorted sequence of n numbers in about 2 + log2(largest / n) bits each: low bits are packed, high parts are
    unary. ``ones`` counts the set bits before each 64-bit word of the unary part."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.high, self.low, self.ones = (arrays[f"{name}.{x}"] for x in ("high", "low", "ones"))
        self.n, self.bits = (int(x) for x in arrays[f"{name}.shape"])
        self.last = int(self.get(np.array([self.n - 1]))[0]) >> self.bits if self.n else 0
        self.zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(np.int64)

    @staticmethod
    def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, int(np.log2(top / n))) if n and top > n else 0
        values = values.astype(U)
        at = (values >> U(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(((int(at[-1]) if n else 0) // 64 + 2) * 64, np.uint8)  # some zeros at the end
        unary[at] = 1
        high = np.packbits(unary, bitorder="little").view(U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1].astype(np.int64)
        low = np.zeros(n * bits // 64 + 2, U)
        if bits:
            begin = np.arange(n, dtype=np.int64) * bits
            word, shift = begin >> 6, (begin & 63).astype(U)
            part = values & U((1 << bits) - 1)
            new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low[word[new]] |= np.bitwise_or.reduceat(part << shift, new)
            low[word[new] + 1] |= np.bitwise_or.reduceat((part >> ONE) >> (U(63) - shift), new)
        return {f"{name}.high": high, f"{name}.low": low, f"{name}.ones": ones, f"{name}.shape": np.array([n, bits], np.int64)}

    def _in_word(self, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit: halves down to a byte, and the byte by a table."""
        k = k.astype(np.uint8)
        place = np.zeros(len(word), np.uint8)
        for width in (32, 16, 8):
            count = np.bitwise_count(word & U((1 << width) - 1))
            over = k >= count
            k -= count * over
            shift = over * np.uint8(width)
            place += shift
            word = word >> shift.astype(U)
        return (place + IN_BYTE[(word & U(255)).astype(np.int64), np.minimum(k, 7)]).astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        begin = i * self.bits
        word, shift = begin >> 6, (begin & 63).astype(U)
        return ((self.low[word] >> shift) | ((self.low[word + 1] << ONE) << (U(63) - shift))) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + self._in_word(self.high[word], i - self.ones[word])
        return (((at - i).astype(U) << U(self.bits)) | self._low(i)).astype(np.int64)

    def _zero(self, j: np.ndarray) -> np.ndarray:
        """Place of the j-th zero; past the end where there is none."""
        word = np.searchsorted(self.zeros, j, "right") - 1
        return word * 64 + self._in_word(~self.high[word], j - self.zeros[word])

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers with high part ``h`` begin and end: the run of ones behind zero number h - 1."""
        h = np.minimum(h, self.last + 1)
        at = np.zeros(len(h), np.int64)
        some = h > 0
        at[some] = self._zero(h[some] - 1) + 1
        shift = (at & 63).astype(U)
        rest = ~(self.high[np.minimum(at >> 6, len(self.high) - 1)] >> shift)
        run = np.bitwise_count((rest & (~rest + ONE)) - ONE).astype(np.int64)
        over = np.flatnonzero(run >= 64 - (at & 63))  # goes on in the next word
        run[over] = self._zero(h[over]) - at[over]
        left = at - h
        return np.minimum(left, self.n), np.minimum(left + run, self.n)

    def successor(self, target: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place from ``begin`` on, ``end`` at most, of a number that is not below ``target``."""
        h, low = target >> self.bits, target.astype(U) & U((1 << self.bits) - 1)
        left, right = self._bucket(h)
        left, right = np.clip(left, begin, end), np.clip(right, begin, end)
        open_ = np.flatnonzero(left < right)
        while len(open_):
            middle = (left[open_] + right[open_]) >> 1
            less = self._low(middle) < low[open_]
            left[open_] = np.where(less, middle + 1, left[open_])
            right[open_] = np.where(less, right[open_], middle)
            open_ = open_[left[open_] < right[open_]]
        return left

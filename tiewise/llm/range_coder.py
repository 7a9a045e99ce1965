"""Adaptive context-mixing range coder for token ids, vectorised over independent blocks.

Each block starts from empty models and is a lane of numpy arrays; all lanes code their n-th id at the
same time. An order-2 and an order-1 context each remember the id that followed them last and how often
it was right. Whether the id is the order-2 guess, the order-1 guess or neither is coded with the mixed
counts of four contexts, weighted by how well each predicted lately. An id that was not guessed is coded
by order-0 statistics as four hexadecimal digits, each under the digits before it.

RangeCoder.java beside this file is the same coder, several times faster: one block a call, the same payload byte
by byte. java_functions() compiles it by the compiler that Spark has for its own generated code, so that executors
code blocks as columns; the store uses that one.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from importlib import resources

import numpy as np
from pyspark.sql import SparkSession

BLOCK = 4096
_U = np.uint64
_MASK, _TOP, _BOTTOM = _U(0xFFFFFFFF), _U(1 << 24), _U(1 << 16)
_ORDER2, _ORDER1, _DIGITS = 1 << 12, 1 << 11, 1 << 9
_HIGHEST = 7


class _Lanes:
    """Model and coder state of n blocks. Given ids, it encodes; given payloads, it decodes."""

    def __init__(self, n: int, data: np.ndarray | None = None):
        self.low, self.range = np.zeros(n, _U), np.full(n, 0xFFFFFFFF, _U)
        self.data, self.at = data, np.zeros(n, np.int64)
        if data is None:
            self.out = np.zeros((n, 1024), np.uint8)
        else:
            self.code = np.zeros(n, _U)
            for _ in range(4):
                self.code = (self.code << _U(8)) | self._next(np.arange(n))
        self.guess2, self.trust2 = np.zeros((n, _ORDER2), np.uint16), np.zeros((n, _ORDER2), np.uint8)
        self.guess1, self.trust1 = np.zeros((n, _ORDER1), np.uint16), np.zeros((n, _ORDER1), np.uint8)
        self.kinds = [np.ones((n, size, 3), np.float64) for size in (64, 8, 8, 3)]
        self.weight = np.ones((n, 4))
        self.digits = np.ones((n, 17 + 256 + _DIGITS, 16), np.uint32)
        self.before1, self.before2, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _next(self, lanes: np.ndarray) -> np.ndarray:
        got = self.data[lanes, np.minimum(self.at[lanes], self.data.shape[1] - 1)].astype(_U)
        self.at[lanes] += 1
        return got

    def _narrow(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        """Take the part [start, start + width) of the range, whose unit is given, and shift out settled bytes."""
        low = (self.low[lanes] + start.astype(_U) * unit) & _MASK
        span = unit * width.astype(_U)
        todo = np.arange(len(lanes))
        while len(todo):
            lo, sp = low[todo], span[todo]
            settled = (lo ^ ((lo + sp) & _MASK)) < _TOP
            small = ~settled & (sp < _BOTTOM)
            go = settled | small
            todo, lo, sp, small = todo[go], lo[go], sp[go], small[go]
            if not len(todo):
                break
            sp = np.where(small, (_U(1 << 32) - lo) & (_BOTTOM - _U(1)), sp)
            which = lanes[todo]
            if self.data is None:
                if self.at[which].max() >= self.out.shape[1]:
                    self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
                self.out[which, self.at[which]] = (lo >> _U(24)).astype(np.uint8)
                self.at[which] += 1
            else:
                self.code[which] = ((self.code[which] << _U(8)) | self._next(which)) & _MASK
            low[todo], span[todo] = (lo << _U(8)) & _MASK, (sp << _U(8)) & _MASK
        self.low[lanes], self.range[lanes] = low, span

    def symbol(self, lanes: np.ndarray, counts: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        """Code value (or read it) under integer counts of each lane's row; the counts add up to 65536 at most."""
        ends = np.cumsum(counts, axis=1)
        unit = self.range[lanes] // ends[:, -1].astype(_U)
        if value is None:
            target = np.minimum(((self.code[lanes] - self.low[lanes]) & _MASK) // unit, (ends[:, -1] - 1).astype(_U)).astype(np.int64)
            value = (ends <= target[:, None]).sum(axis=1)
        row = np.arange(len(lanes))
        width = counts[row, value]
        self._narrow(lanes, ends[row, value] - width, width, unit)
        return value

    def _digit(self, lanes: np.ndarray, node: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        counts = self.digits[lanes, node].astype(np.int64)
        value = self.symbol(lanes, counts, value)
        self.digits[lanes, node, value] += np.uint32(24)
        full = counts.sum(axis=1) > 8000
        if full.any():
            self.digits[lanes[full], node[full]] = (self.digits[lanes[full], node[full]] + np.uint32(1)) >> np.uint32(1)
        return value

    def step(self, n: int, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first n lanes."""
        lanes = np.arange(n)
        one, two = self.before1[:n], self.before2[:n]
        at2 = ((one * 40503 + two * 30011) >> 3) % _ORDER2
        at1 = (one * 40503 >> 4) % _ORDER1
        g2, g1 = self.guess2[lanes, at2].astype(np.int64), self.guess1[lanes, at1].astype(np.int64)
        t2, t1 = self.trust2[lanes, at2].astype(np.int64), self.trust1[lanes, at1].astype(np.int64)
        t1 = np.where(g1 == g2, 0, t1)
        contexts = (t2 * 8 + t1, t2, t1, self.last[:n])
        rows = [k[lanes, c] for k, c in zip(self.kinds, contexts, strict=True)]
        # In this order of operations, which RangeCoder.java follows.
        scale = np.stack([1 / (r[:, 0] + r[:, 1] + r[:, 2]) for r in rows], axis=1)
        w = self.weight[:n]
        v = scale * w
        mixed = (rows[0] * v[:, 0:1] + rows[1] * v[:, 1:2] + rows[2] * v[:, 2:3] + rows[3] * v[:, 3:4]) * (16000 / (w[:, 0] + w[:, 1] + w[:, 2] + w[:, 3]))[:, None]
        counts = mixed.astype(np.int64) + 1
        kind = None if ids is None else np.where(ids == g2, 0, np.where(ids == g1, 1, 2))
        kind = self.symbol(lanes, counts, kind)
        for k, c in zip(self.kinds, contexts, strict=True):
            k[lanes, c] *= 0.98
            k[lanes, c, kind] += 1
        share = np.stack([r[lanes, kind] for r in rows], axis=1) * scale
        self.weight[:n] = 0.9 * w + 0.1 * (share * share + 0.01)
        found = np.where(kind == 0, g2, g1)
        miss = np.nonzero(kind == 2)[0]
        if len(miss):
            x = None if ids is None else ids[miss]
            digit = lambda shift: None if x is None else (x >> shift) & 15
            a = self._digit(miss, np.zeros(len(miss), np.int64), digit(12))
            b = self._digit(miss, 1 + a, digit(8))
            c = self._digit(miss, 17 + a * 16 + b, digit(4))
            d = self._digit(miss, 273 + ((a * 256 + b * 16 + c) * 40503 >> 4) % _DIGITS, digit(0))
            found[miss] = a * 4096 + b * 256 + c * 16 + d
        for guess, trust, at, g in ((self.guess2, self.trust2, at2, g2), (self.guess1, self.trust1, at1, g1)):
            right, t = found == g, trust[lanes, at]
            trust[lanes, at] = np.where(right, np.minimum(t + 1, _HIGHEST), t // 2)
            guess[lanes, at] = np.where(right | (t > 1), g, found)
        self.before2[:n], self.before1[:n], self.last[:n] = one.copy(), found, kind
        return found

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        self.out = np.concatenate([self.out, np.zeros((len(lanes), 4), np.uint8)], axis=1)
        for i in range(4):
            self.out[lanes, self.at] = (self.low >> _U(24)).astype(np.uint8)
            self.low = (self.low << _U(8)) & _MASK
            self.at += 1
        return [self.out[i, : self.at[i]].tobytes() for i in lanes]


def encode_blocks(blocks: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(number of ids, crc32 of the ids as little-endian unsigned 32-bit integers, payload) of blocks of ids below 65536."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((len(blocks), max([0, *lengths])), np.int64)
    for row, i in enumerate(order):
        ids[row, : lengths[row]] = blocks[i]
    lanes = _Lanes(len(blocks))
    for t in range(ids.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        lanes.step(n, ids[:n, t])
    out: list = [None] * len(blocks)
    for i, payload in zip(order, lanes.finish(), strict=True):
        out[i] = (len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes()), payload)
    return out


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of each block; a block whose checksum differs raises ValueError."""
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    lengths = np.array([blocks[i][0] for i in order])
    data = np.zeros((len(blocks), max(8, *(len(b[2]) + 4 for b in blocks)) if blocks else 8), np.uint8)
    for row, i in enumerate(order):
        data[row, : len(blocks[i][2])] = np.frombuffer(blocks[i][2], np.uint8)
    lanes = _Lanes(len(blocks), data)
    ids = np.zeros((len(blocks), int(max([0, *lengths]))), np.int64)
    for t in range(ids.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        ids[:n, t] = lanes.step(n, None)
    out: list = [None] * len(blocks)
    for row, i in enumerate(order):
        out[i] = ids[row, : lengths[row]]
        if zlib.crc32(out[i].astype("<u4").tobytes()) != blocks[i][1]:
            raise ValueError("a block's checksum differs from its ids")
    return out


_FUNCTIONS = {"encode": "tiewise_range_encode", "decode": "tiewise_range_decode"}
_COMPILED: dict[str, tuple] = {}


def java_functions(spark: SparkSession) -> dict[str, str]:
    """Names of SQL functions of RangeCoder.java, registered in this session.

    `encode`(ids as little-endian unsigned 16-bit integers) and `decode`(payload, number of ids) are of binary columns.
    """
    from pyspark.sql.types import BinaryType

    app = spark.sparkContext.applicationId
    if app not in _COMPILED:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(resources.files(__package__).joinpath("RangeCoder.java").read_text())
        made = compiler.getBytecodes()
        folder = tempfile.TemporaryDirectory(prefix="tiewise-")  # kept as long as this process: executors fetch from it
        path = os.path.realpath(f"{folder.name}/range_coder.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name in made:
                jar.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
        spark.sparkContext._jsc.sc().addJar(path)
        loader = compiler.getClassLoader()
        kinds = {k: loader.loadClass(f"tiewise.RangeCoder${k.capitalize()}") for k in _FUNCTIONS}
        _COMPILED[app] = folder, kinds, jvm.org.apache.spark.sql.types.DataType.fromJson(BinaryType().json())
    _, kinds, binary = _COMPILED[app]
    for k, name in _FUNCTIONS.items():
        spark._jsparkSession.udf().register(name, kinds[k].newInstance(), binary)
    return dict(_FUNCTIONS)

"""An adaptive context-mixing range coder for token ids.

A segment of ids is coded on its own, from a fresh model: orders 1 and 2 each predict one id for
the context (the last id, the last two), with a confidence; a logistic mix of what their
confidences, and order 0, have been worth says how likely the better prediction is; the coder
codes whether it holds. Ids that weren't predicted are coded by their frequencies among these.
All arithmetic is on integers, so any machine decodes what another has coded.

A segment is laid out as lanes of equal length (the last ids are filled up with zeros) which are
coded side by side and share the segment's model: step t codes the t-th id of all lanes, then the
model learns from them. Lanes have range coders of their own. The mix depends on confidences
only, so it is made for all of their combinations, not for each id.

Segment: "TIDS", u8 version, u8 wide, u32 crc32 of what follows; u32 symbols, u32 crc32 of them as
little-endian u32; u32 unpredicted, u32 bytes of their zlib-packed frequencies, u32 bytes of
predictions' code; then frequencies, predictions' code, unpredicted ids' code. A code is a u16
count of words for each lane, then the lanes' 16-bit words. All numbers are little-endian.
Symbols are the ids; if one of a segment's is 65,536 or more, it is wide: each id is two
symbols, its upper and its lower 16 bits.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TIDS", 3
_HEAD, _BODY = struct.Struct("<4sBBI"), struct.Struct("<IIIII")
#: Lanes of a segment at most, and their length at least.
LANES, LEAST = 4096, 256
#: Words of a lane at most: longer segments get more lanes.
LONGEST = 32_768
_SLOTS, _EVERY = 1 << 15, 16
_WHOLE, _LOW = 1 << 48, 1 << 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: -2047..2047 to 12 bits of probability; stretch: its inverse. By rule, rounded."""
    x = np.arange(-2048, 2048) / 256.0
    squash = np.clip(np.rint(4096 / (1 + np.exp(-x))), 1, 4095).astype(np.int64)
    p = (np.arange(4096) + 0.5) / 4096
    return squash, np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int64)


_SQUASH, _STRETCH = _tables()
_SURE = np.arange(8)
#: What a confidence changes by when the prediction was wrong (first 8) or right.
_STEP = np.concatenate(((_SURE >> 1) - _SURE, np.minimum(_SURE + 1, 7) - _SURE))


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, their length) of n symbols."""
    lanes = max(1, min(LANES, n // LEAST), -(-n // LONGEST))
    return lanes, -(-n // lanes)


class _Model:
    """Entries are id * 8 + confidence. ``odds`` has the 12-bit probability that the prediction
    holds for (both orders agree, confidence of order 2, of order 1)."""

    def __init__(self, lanes: int) -> None:
        self.one, self.two = np.zeros(1 << 16, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        self.last, self.slot = np.zeros((2, lanes), dtype=np.int64)
        self.held = [np.ones((2, 8), dtype=np.int64), np.ones((2, 8), dtype=np.int64), np.ones(1, dtype=np.int64)]
        self.came = [2 * h for h in self.held]
        self.weights = np.array([1 << 15, 1 << 15, 1 << 13])
        self.seen, self.steps = np.zeros(256, dtype=np.int64), 0
        self._mix()

    def _mix(self) -> None:
        w1, w2, w0 = [_STRETCH[4095 * h // c] for h, c in zip(self.held, self.came, strict=True)]
        self.inputs = np.stack([x.astype(np.int64) for x in np.broadcast_arrays(w1[:, None, :], w2[:, :, None], w0[:, None, None])])
        mix = (self.inputs * self.weights[:, None, None, None]).sum(axis=0) >> 16
        self.odds = np.clip(_SQUASH[np.clip(mix, -2047, 2047) + 2048], 16, 4080).reshape(-1)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predicted ids, and the 12-bit probabilities that they hold."""
        self.e1, self.e2 = self.one.take(self.last), self.two.take(self.slot)
        self.id1, self.id2 = self.e1 >> 3, self.e2 >> 3
        self.s1, self.s2 = self.e1 & 7, self.e2 & 7
        self.context = (self.id1 == self.id2) * 64 + (self.s2 << 3) + self.s1
        return np.where(self.s2 > 0, self.id2, self.id1), self.odds.take(self.context)

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        fresh = (ids << 3) + 1
        for table, at, entry, got, sure in ((self.one, self.last, self.e1, self.id1, self.s1), (self.two, self.slot, self.e2, self.id2, self.s2)):
            right = got == ids
            new = entry + _STEP.take(sure + 8 * right)
            table[at] = np.where(right | (sure > 0), new, fresh)  # of lanes at one place, the last
        self.slot = ((ids * 40503 + self.last * 30011) >> 2) & (_SLOTS - 1)
        self.last = ids
        self.seen += np.bincount(self.context + 128 * hit, minlength=256)
        self.steps += 1
        if self.steps % _EVERY == 0 or self.steps < 16:
            self._settle()

    def _settle(self) -> None:
        missed, held = self.seen.reshape(2, 2, 8, 8)
        came = missed + held
        error = held * 4096 - came * self.odds.reshape(2, 8, 8)
        self.weights += (self.inputs * error).sum(axis=(1, 2, 3)) // came.sum() >> 5
        for i, axis in enumerate((1, 2, (0, 1, 2))):
            self.held[i] += held.sum(axis=axis)
            self.came[i] += came.sum(axis=axis)
            full = self.came[i] > 1 << 18
            self.held[i][full] >>= 1
            self.came[i][full] >>= 1
        self.seen[:] = 0
        self._mix()


class _Encoder:
    """Words are kept with their carries, which are added at the end."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.range = np.zeros(lanes, dtype=np.int64), np.full(lanes, _WHOLE, dtype=np.int64)
        self.words, self.at, self.lanes = np.zeros((steps + 1) * lanes, dtype=np.int64), np.arange(lanes), lanes

    def put(self, low: np.ndarray, width: np.ndarray) -> None:
        """Narrows to ``width`` from ``low`` on; at least 1 / 65536 of what was is left."""
        self.words[self.at] = low >> 32
        short = width < _LOW
        self.low = np.where(short, (low & (_LOW - 1)) << 16, low)
        self.range = width << (short * np.int64(16))
        self.at += short * np.int64(self.lanes)

    def finish(self) -> bytes:
        self.words[self.at] = (self.low + _LOW - 1) >> 32
        words = self.words.reshape(-1, self.lanes)
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 16
            words[k] &= 0xFFFF
        n = self.at // self.lanes + 1
        return n.astype("<u2").tobytes() + words.T[np.arange(len(words)) < n[:, None]].astype("<u2").tobytes()


class _Decoder:
    def __init__(self, code: bytes, lanes: int) -> None:
        n = np.frombuffer(code[: 2 * lanes], dtype="<u2").astype(np.int64)
        words = np.frombuffer(code[2 * lanes :], dtype="<u2")
        if len(n) != lanes or int(n.sum()) != len(words):
            raise ValueError("a segment of token ids is cut short or too long")
        grid = np.zeros((lanes, int(n.max(initial=0)) + 3), dtype=np.int64)
        grid[np.arange(grid.shape[1]) < n[:, None]] = words
        self.words, self.lanes = grid.T.reshape(-1), lanes
        self.code, self.range = (grid[:, 0] << 32) | (grid[:, 1] << 16) | grid[:, 2], np.full(lanes, _WHOLE, dtype=np.int64)
        self.at = np.arange(lanes) + 3 * lanes

    def took(self, low: np.ndarray, width: np.ndarray) -> None:
        short = width < _LOW
        code = self.code - low
        self.code = np.where(short, (code << 16) | self.words.take(self.at, mode="clip"), code)
        self.range = width << (short * np.int64(16))
        self.at += short * np.int64(self.lanes)


def _grid(symbols: np.ndarray) -> np.ndarray:
    """(steps, lanes): the symbols, lane by lane, filled up with zeros."""
    lanes, steps = _lanes(len(symbols))
    filled = np.zeros(lanes * steps, dtype=np.int64)
    filled[: len(symbols)] = symbols
    return np.ascontiguousarray(filled.reshape(lanes, steps).T)


def _frequencies(symbols: np.ndarray) -> np.ndarray:
    """Of each symbol up to the greatest, 65,536 in all: one at least for those that are there."""
    count = np.bincount(symbols)
    there = count > 0
    left = 65_536 - int(there.sum())
    out = np.where(there, 1 + count * left // int(count.sum()), 0)
    out[int(count.argmax())] += 65_536 - int(out.sum())
    return out


def _encode_plain(symbols: np.ndarray, frequency: np.ndarray) -> bytes:
    grid = _grid(symbols)
    start = np.cumsum(frequency) - frequency
    coder = _Encoder(grid.shape[1], grid.shape[0])
    for row in grid:
        unit = coder.range >> 16
        coder.put(coder.low + start.take(row) * unit, frequency.take(row) * unit)
    return coder.finish()


def _decode_plain(code: bytes, n: int, frequency: np.ndarray) -> np.ndarray:
    lanes, steps = _lanes(n)
    start = np.cumsum(frequency) - frequency
    owner = np.repeat(np.arange(len(frequency)), frequency)
    coder, grid = _Decoder(code, lanes), np.empty((steps, lanes), dtype=np.int64)
    for t in range(steps):
        unit = coder.range >> 16
        row = owner.take(coder.code // unit, mode="clip")
        grid[t] = row
        coder.took(start.take(row) * unit, frequency.take(row) * unit)
    return grid.T.reshape(-1)[:n]


def _encode(symbols: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code of the predictions, and what wasn't predicted, by steps and then lanes."""
    grid = _grid(symbols)
    steps, lanes = grid.shape
    model, coder, rest = _Model(lanes), _Encoder(lanes, steps), []
    for ids in grid:
        guess, p = model.predict()
        hit = ids == guess
        part = (coder.range >> 12) * p
        coder.put(np.where(hit, coder.low, coder.low + part), np.where(hit, part, coder.range - part))
        rest.append(ids[~hit])
        model.learn(ids, hit)
    return coder.finish(), np.concatenate(rest)


def _decode(code: bytes, n: int, rest: np.ndarray) -> np.ndarray:
    lanes, steps = _lanes(n)
    model, coder, grid, used = _Model(lanes), _Decoder(code, lanes), np.empty((steps, lanes), dtype=np.int64), 0
    for t in range(steps):
        ids, p = model.predict()
        part = (coder.range >> 12) * p
        hit = coder.code < part
        coder.took(np.where(hit, 0, part), np.where(hit, part, coder.range - part))
        missed = np.flatnonzero(~hit)
        ids[missed] = rest[used : used + len(missed)]
        used += len(missed)
        model.learn(ids, hit)
        grid[t] = ids
    return grid.T.reshape(-1)[:n]


def pack_ids(ids: np.ndarray) -> bytes:
    """A segment of ids, each an unsigned 32-bit integer."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
        raise ValueError("ids are unsigned 32-bit integers")
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    if wide:
        ids = np.stack((ids >> 16, ids & 0xFFFF), axis=1).reshape(-1)
    code, rest = _encode(ids) if len(ids) else (b"", ids)
    packed, plain = b"", b""
    if len(rest):
        frequency = _frequencies(rest)
        packed, plain = zlib.compress((frequency & 0xFFFF).astype("<u2").tobytes()), _encode_plain(rest, frequency)
    body = b"".join([_BODY.pack(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(rest), len(packed), len(code)), packed, code, plain])
    return _HEAD.pack(MAGIC, VERSION, wide, zlib.crc32(body)) + body


def unpack_ids(data: bytes) -> np.ndarray:
    """The ids of a segment, as little-endian u32; raises ValueError on damage."""
    if data[:4] != MAGIC or len(data) < _HEAD.size + _BODY.size or data[4] != VERSION:
        raise ValueError("not a segment of token ids of this version")
    _, _, wide, crc = _HEAD.unpack_from(data)
    body = data[_HEAD.size :]
    if zlib.crc32(body) != crc:
        raise ValueError("a segment of token ids doesn't match its checksum")
    n, own, left, packed, size = _BODY.unpack_from(body)
    at = _BODY.size
    rest = np.zeros(0, dtype=np.int64)
    if left:
        frequency = np.frombuffer(zlib.decompress(body[at : at + packed]), dtype="<u2").astype(np.int64)
        if not frequency.any():  # one symbol has all 65,536
            frequency[-1] = 65_536
        rest = _decode_plain(body[at + packed + size :], left, frequency)
    ids = _decode(body[at + packed : at + packed + size], n, rest) if n else rest
    ids = ids.astype("<u4")
    if zlib.crc32(ids.tobytes()) != own:
        raise ValueError("token ids don't match their checksum")
    return (ids[0::2] << np.uint32(16)) | ids[1::2] if wide else ids

"""Static range asymmetric numeral system over token ids, vectorised over interleaved lanes.

A block holds its own lane states and words, so blocks decode independently; checkpoints inside a
block hold the lane states and the word position after every `CHECK_STEPS` steps, so a block can be
decoded from the middle; a checksum of the decoded ids guards each block.

Block: header (n ids, lanes, checkpoints, words, crc32 of ids), final states, checkpoints, words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63); words are 32 bits
LANES, CHECK_STEPS = 2048, 128
HEAD = struct.Struct("<QIIII")


def table(counts: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Frequencies that sum to 2^bits from counts of all symbols; every counted symbol gets at least 1."""
    used = np.flatnonzero(counts)
    if bits is None:
        bits = max(12, int(max(1, 2 * len(used)) - 1).bit_length() + 2)
    total, size = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.uint32)
    if not len(used):
        return freq
    share = np.maximum(1, np.floor(counts[used] * ((size - len(used)) / total))).astype(np.int64)
    share[int(np.argmax(share))] += size - int(share.sum())
    freq[used] = share
    return freq


class Coder:
    """Lookup arrays of one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        size = int(self.freq.sum())
        self.bits = np.uint64(max(1, size).bit_length() - 1)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64(max(1, size) - 1)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 64)))
        steps = -(-n // lanes)
        state, out, checks = np.full(lanes, LOW, np.uint64), [], []
        f_all, s_all = self.freq[ids], self.start[ids]
        limit = f_all << np.uint64(63 - int(self.bits))
        n_words = 0
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            full = x >= limit[a:b]
            if full.any():
                emitted = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                out.append(emitted)
                n_words += len(emitted)
                x[full] >>= np.uint64(32)
            q, r = np.divmod(x, f_all[a:b])
            state[: b - a] = (q << self.bits) + r + s_all[a:b]
            if step and step % CHECK_STEPS == 0:
                checks.append((step, n_words, state.copy()))
        stream = np.concatenate(out[::-1]) if out else np.empty(0, "<u4")
        body = [HEAD.pack(n, lanes, len(checks), n_words, zlib.crc32(ids.astype("<u4").tobytes())), state.astype("<u8").tobytes()]
        body += [struct.pack("<II", step, n_words - at) + x.astype("<u8").tobytes() for step, at, x in reversed(checks)]
        return b"".join([*body, stream.tobytes()])

    def decode(self, block: bytes, first_id: int = 0, end_id: int | None = None) -> np.ndarray:
        """The ids from first_id to end_id of a block: decoding starts at the last checkpoint before them and stops behind them.

        The states and word positions of the checkpoints passed on the way are verified; so is the
        checksum, where the whole block is decoded.
        """
        n, lanes, n_checks, n_words, crc = HEAD.unpack_from(block)
        end_id = n if end_id is None else min(end_id, n)
        at = HEAD.size
        state, pos, first = np.frombuffer(block, "<u8", lanes, at).copy(), 0, 0
        at += 8 * lanes
        checks = {}
        for j in range(n_checks):
            here = at + j * (8 + 8 * lanes)
            step, word = struct.unpack_from("<II", block, here)
            checks[step] = (word, np.frombuffer(block, "<u8", lanes, here + 8))
        if passed := [step for step in checks if step * lanes <= first_id]:
            first = max(passed)
            pos, state = checks[first][0], checks[first][1].copy()
        stream = np.frombuffer(block, "<u4", n_words, at + n_checks * (8 + 8 * lanes))
        last = -(-end_id // lanes) if end_id > first_id else first
        out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
        for step in range(first, last):
            if step in checks and (pos != checks[step][0] or (state != checks[step][1]).any()):
                raise ValueError("a block is damaged")
            a, b = step * lanes, min(n, (step + 1) * lanes)
            x = state[: b - a]
            slot = x & self.mask
            sym = self.symbol[slot]
            out[a - first * lanes : b - first * lanes] = sym
            x = self.freq[sym] * (x >> self.bits) + slot - self.start[sym]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | stream[pos : pos + len(low)].astype(np.uint64)
                pos += len(low)
            state[: b - a] = x
        if last * lanes >= n and (state != LOW).any() or first == 0 and end_id == n and zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a block is damaged")
        return out[first_id - first * lanes : end_id - first * lanes]

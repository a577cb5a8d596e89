"""Vectorised word hashing over whole texts, shared by the text operators.

A text is taken as UTF-8 bytes; A-Z are lower-cased and words are the maximal
runs of bytes other than 0x20 and 0x09-0x0D (those bytes never occur inside a
multi-byte character).  Each word gets a 64-bit hash: its bytes in lanes of
eight, each lane mixed under a key of its own place, the mixed lanes summed and
mixed again with the word's length.  A lane holds its bytes whole, so words of
up to eight bytes and equal length never share a hash, and no structure of a
longer word survives the mixing.  Nothing is truncated: long inputs are walked
in segments cut at white space, so memory stays bounded by the segment size (or
the longest single word).
"""

from __future__ import annotations

import sys
import types

import numpy as np

SEGMENT_BYTES = 1 << 20
#: What the keys of lanes are made from.
_SEED, _STEP = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
_U = np.uint64

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for words without their punctuation.
_LOOSE = _WS.copy()
_LOOSE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32



def worker_memory() -> dict:
    """A dictionary that lives as long as the Python process and never travels with a function."""
    return sys.modules.setdefault("_pactum_memory", types.ModuleType("_pactum_memory")).__dict__


def tidy() -> None:
    """Give memory that is free again back to the machine; workers are reused and stand beside a JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby inputs land far apart."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Words:
    """Words of one run of texts: hashes, byte bounds and the text each is from."""

    __slots__ = ("cumulative", "doc", "end", "hash", "raw", "start")

    def __init__(self, raw, start, end, doc, word_hash, cumulative):
        self.raw, self.start, self.end, self.doc, self.hash, self.cumulative = raw, start, end, doc, word_hash, cumulative

    def prefix_hash(self, k: int) -> np.ndarray:
        """Hash of each word's first k bytes (of the whole word if shorter), told apart by k."""
        stop = np.minimum(self.start + k, self.end)
        return _finish(self.cumulative, self.start, stop, 0x51 + 2 * k)


def _finish(cumulative, start, stop, salt: int) -> np.ndarray:
    """Hashes of the bytes from start to stop (words or their beginnings), told apart by length and salt."""
    length = stop - start
    lanes = np.maximum((length + 7) >> 3, 1)
    with np.errstate(over="ignore"):
        if len(lanes) and lanes.max() == 1:
            total = mix64((cumulative[stop] - cumulative[start]) ^ mix64(np.array([_SEED], dtype=np.uint64)))
        elif len(lanes):
            first = np.cumsum(lanes) - lanes
            place = np.arange(first[-1] + lanes[-1]) - np.repeat(first, lanes)
            begin = np.repeat(start, lanes) + 8 * place
            end = np.minimum(begin + 8, np.repeat(stop, lanes))
            key = mix64(place.astype(np.uint64) * _U(_STEP) + _U(_SEED))
            total = np.add.reduceat(mix64((cumulative[end] - cumulative[begin]) ^ key), first)
        else:
            total = np.zeros(0, dtype=np.uint64)
        return mix64(total + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(salt))


def _hash_buffer(raw: bytes, doc_of_byte_end: np.ndarray, loose: bool = False) -> Words:
    arr = np.frombuffer(raw, dtype=np.uint8)
    ws = (_LOOSE if loose else _WS)[arr]
    edge = np.flatnonzero(ws[1:] != ws[:-1]) + 1
    bounds = edge
    if not ws[0]:
        bounds = np.concatenate(([0], bounds))
    if not ws[-1]:
        bounds = np.concatenate((bounds, [len(arr)]))
    start, end = bounds[0::2], bounds[1::2]
    # each byte is shifted to its place in its lane; a lane is then the difference of two running sums, modulo 2**64
    shift = np.arange(len(arr), dtype=np.uint8)
    if len(start):
        shift[start[0] :] -= np.repeat(start.astype(np.uint8), np.diff(np.append(start, len(arr))))
    shift &= 7
    shift <<= 3
    with np.errstate(over="ignore"):
        cumulative = np.empty(len(arr) + 1, dtype=np.uint64)
        cumulative[0] = 0
        np.cumsum(_LOWER[arr].astype(np.uint64) << shift, out=cumulative[1:])
    doc = np.searchsorted(doc_of_byte_end, start, side="right")
    return Words(raw, start, end, doc, _finish(cumulative, start, end, 0x51), cumulative)


def encode(text) -> bytes:
    """UTF-8 bytes of a text (or of bytes, or of null: none)."""
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


class TextColumn:
    """The texts of an Arrow string column as bytes, cut out one at a time and never all copied."""

    def __init__(self, column):
        import pyarrow as pa

        large = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
        self.data, self.nulls = data, column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __iter__(self):
        for k in range(len(self)):
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            yield b"" if a == b or (self.nulls is not None and self.nulls[k]) else self.data[a:b].to_pybytes()


def _cuts(blob: bytes, limit: int) -> list[bytes]:
    """Pieces of at most `limit` bytes, cut at white space where there is any."""
    out, at = [], 0
    while len(blob) - at > limit:
        stop = at + limit
        cut = max(blob.rfind(c, at, stop) for c in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            later = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := blob.find(c, stop)) >= 0]
            if not later:
                break
            cut = min(later)
        out.append(blob[at : cut + 1])
        at = cut + 1
    out.append(blob[at:])
    return out


def runs(texts, limit: int = SEGMENT_BYTES, loose: bool = False):
    """Yield (first, Words) over consecutive texts, about `limit` bytes at a time.

    Words.doc counts from `first`.  A text larger than `limit` comes as several
    consecutive runs with the same `first` and doc 0.
    """
    first, held, size = 0, [], 0
    for k, text in enumerate(texts):
        blob = encode(text)
        if held and size + len(blob) > limit:
            yield first, _joined(held, loose)
            first, held, size = k, [], 0
        if len(blob) > limit:
            for piece in _cuts(blob, limit):
                yield k, _joined([piece], loose)
            first = k + 1
            continue
        held.append(blob)
        size += len(blob) + 1
    if held:
        yield first, _joined(held, loose)


def _joined(blobs: list[bytes], loose: bool = False) -> Words:
    raw = b"\n".join(blobs) + b"\n"
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs)))
    return _hash_buffer(raw, ends, loose)


def word_hashes(texts, loose: bool = False):
    """Yield (k, hashes) once for each text in order, over the whole text; loose: punctuation separates words too."""
    pending_k, pending = None, []
    n = 0
    for first, w in runs(texts, loose=loose):
        last = int(w.doc[-1]) if len(w.doc) else -1
        cut = np.searchsorted(w.doc, np.arange(last + 2))
        for d in range(last + 1):
            k = first + d
            part = w.hash[cut[d] : cut[d + 1]]
            if k == pending_k:
                pending.append(part)
                continue
            if pending_k is not None:
                yield pending_k, pending[0] if len(pending) == 1 else np.concatenate(pending)
                n = pending_k + 1
            while n < k:
                yield n, _NONE
                n += 1
            pending_k, pending = k, [part]
    if pending_k is not None:
        yield pending_k, pending[0] if len(pending) == 1 else np.concatenate(pending)
        n = pending_k + 1
    while n < len(texts):
        yield n, _NONE
        n += 1


_NONE = np.zeros(0, dtype=np.uint64)
_STEPS = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words in order; of the whole sequence if shorter; none without words."""
    n = len(words)
    if n == 0:
        return _NONE
    k = min(n, width)
    with np.errstate(over="ignore"):
        total = np.full(n - k + 1, k * 0x2545F4914F6CDD1D % (1 << 64), dtype=np.uint64)
        for i in range(k):
            step = _STEPS[i % len(_STEPS)] + 2 * (i // len(_STEPS)) * 0x1000193
            total += mix64(words[i : n - k + 1 + i] + _U(step % (1 << 64))) * _U(step % (1 << 64) | 1)
    return mix64(total)

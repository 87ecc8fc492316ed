"""Words, hashes and chunks over the UTF-8 buffers of Arrow string columns.

Everything here works on whole texts and on numpy views of the Arrow buffers,
so that no Python string is made for a document.  A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at a time; a longer document is one chunk.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
#: A random odd number for each byte value, and the base of the rolling hash with its inverse modulo 2**64.
BYTE_HASH = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _table(characters) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SPACES = _table([0x20, *range(0x09, 0x0E)])
#: Bytes of `[^\x20\x09-\x0D]+`
SPACED_WORD = ~SPACES
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case
NORMAL_WORD = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
NOT_NEWLINE = ~_table([0x0A])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: The same words as patterns, for SQL.
SPACED_PATTERN = r"[^\x20\x09-\x0D]+"
NORMAL_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sql_words(column: str, pattern: str, lower: bool = False) -> str:
    """DuckDB SQL for the words of a text (null: none), with A-Z in lower case if asked."""
    text = f"coalesce({column}, '')"
    if lower:
        text = f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"
    return f"regexp_extract_all({text}, '{pattern}')"

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            out = np.empty(size, U64)
            out[0], have = 1, 1
            while have < size:
                step = min(have, size - have)
                out[have : have + step] = out[:step] * U64(pow(b, have, 1 << 64))
                have += step
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and where each text begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_string())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in those bytes) of runs of whole texts."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def segments(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes, never across texts, and the runs' own offsets by text."""
    n = len(data)
    inside = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() has the hash of any span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_HASH[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever they stand.  It is a sum of powers: enough for
    choosing places, not for telling long texts apart (see byte_hashes()).
    """
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 512


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span that is not linear in them: eight bytes at a time are mixed into
    what went before, so texts made to agree in sums of powers (Thue-Morse strings) differ.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * U64(0xD6E8FEB86659FD93) + U64(seed))
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.flatnonzero(size <= LONG_SPAN)
    done = 0
    while True:
        live = live[size[live] > done]
        if not len(live):
            break
        part = eight[starts[live] + done].view(np.uint64)[:, 0]
        left = size[live] - done
        short = left < 8
        part[short] &= (U64(1) << (left[short].astype(np.uint64) * U64(8))) - U64(1)
        out[live] = mix((out[live] ^ part) * U64(0x9FB21C651E98DF25))
        done += 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; one for each first word, n - 1 fewer than words."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        out = mix(out * U64(BASE) + words[k : len(words) - n + 1 + k])
    return out


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each item, the number of the text that holds it."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

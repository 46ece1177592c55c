"""Words of whole Arrow batches as 64-bit hashes, with numpy instead of a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at a time; a longer text is taken alone.
CHUNK = 2_000_000
_CONTROL = r"[\x00-\x08\x0E-\x1B\x7F]+"
_WIDE = r"[^\p{L}\p{N}\x00-\x7F]+"
_MARKUP = r"</?[A-Za-z][^<>]*>|&(?:[a-z]{2,8}|#\d{1,6});"
_SHOWN = np.zeros(256, bool)
_SHOWN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def clean(texts: pa.Array) -> pa.Array:
    """Lower case, one width of characters, no markup or invisible characters; only letters and digits beyond ASCII. Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    wide = pc.invert(pc.string_is_ascii(texts))
    if pc.any(wide).as_py():
        t = pc.utf8_normalize(texts.filter(wide), "NFKC")
        t = pc.replace_substring_regex(t, r"[\p{Cf}\p{Mn}]+", "")
        texts = pc.replace_with_mask(texts, wide, t)
    odd = pc.match_substring_regex(texts, _CONTROL)
    if pc.any(odd).as_py():
        texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(texts.filter(odd), _CONTROL, ""))
    marked = pc.match_substring_regex(texts, r"[<&]")
    if pc.any(marked).as_py():
        texts = pc.replace_with_mask(texts, marked, pc.replace_substring_regex(texts.filter(marked), _MARKUP, " "))
    if pc.any(wide).as_py():
        texts = pc.replace_with_mask(texts, wide, pc.replace_substring_regex(texts.filter(wide), _WIDE, " "))
    return pc.utf8_lower(texts)


def parts(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text."""
    n = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0.0) + size, "right")))
        yield at, end
        at = end


def word_hashes(cleaned: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of cleaned texts, in order."""
    return word_places(cleaned)[:2]


def word_places(cleaned: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of every word of cleaned texts, in order, and the bytes in which they lie."""
    offsets = np.frombuffer(cleaned.buffers()[1], np.int32)[cleaned.offset : cleaned.offset + len(cleaned) + 1].astype(np.int64)
    data = cleaned.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    shown = _SHOWN[b]
    first = shown.copy()
    first[1:] &= ~shown[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(b)]
    first[edge] |= shown[edge]
    start = np.flatnonzero(first)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, b
    inside = np.flatnonzero(shown)
    begins = np.searchsorted(inside, start)
    size = np.diff(np.append(begins, len(inside)))
    place = np.arange(len(inside)) - np.repeat(begins, size)
    h = np.add.reduceat(_BYTE[b[inside]] * _PLACE[place & 4095], begins)
    return np.searchsorted(offsets, start, "right") - 1, mix(h), start, start + size, b


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of each (row, word, occurrence), in order: rows of two sides have as many keys in common as they share words."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key, row = key[order], row[order]
    if not len(key):
        return key, row
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return key + nth.astype(np.uint64), row


def within(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each key is one of the others; both are in order."""
    if not len(others):
        return np.zeros(len(keys), bool)
    return others[np.minimum(np.searchsorted(others, keys), len(others) - 1)] == keys

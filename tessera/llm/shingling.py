"""Word shingles of texts as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_PLACES = [np.uint64(x) for x in np.random.default_rng(20240302).integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z count as a-z, ASCII white space parts words.

    With fewer words the whole sequence is the only shingle; without words there is none.
    """
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ hashes[k : k + n]) * _PLACES[k % 16]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)

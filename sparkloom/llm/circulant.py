"""Circulant MinHash signatures: one permutation scatters the shingles, a second one, shifted circularly by 1, 2, ... K
places, gives all K signature coordinates."""

from __future__ import annotations

import numpy as np

UNIVERSE = 1 << 20
ROWS = 5
BANDS = 26
_CHUNK = 2048
_FOLD = np.random.default_rng(77).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Circulant:
    """Signatures of ``rows * bands`` coordinates over a universe of 2**20 places (two tables of 4 MB)."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.rows, self.bands, self.size = rows, bands, rows * bands
        self.scatter = rng.permutation(UNIVERSE).astype(np.int32)
        second = rng.permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([second, second[: self.size]])
        self.windows = np.lib.stride_tricks.sliding_window_view(ring, self.size)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The minimum of each shifted permutation over a non-empty set."""
        place = self.scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        best = self.windows[place[:_CHUNK]].min(axis=0)
        for at in range(_CHUNK, len(place), _CHUNK):
            np.minimum(best, self.windows[place[at : at + _CHUNK]].min(axis=0), out=best)
        return best

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        table = (self.signature(shingles).astype(np.uint64) + np.uint64(1)).reshape(self.bands, self.rows)
        key = (table * _FOLD[: self.rows]).sum(axis=1, dtype=np.uint64)
        return (key ^ (key >> np.uint64(29))).view(np.int64)

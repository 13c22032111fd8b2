"""A two-level compressed bitmap: 4096-ordinal containers, sparse or packed, whichever is smaller."""

from __future__ import annotations

import numpy as np

BITS = 12
SPAN = 1 << BITS


class Container:
    """The members of one span of ordinals. Few members: a sorted uint16 array; else packed bits."""

    __slots__ = ("packed", "sparse")

    def __init__(self, members: np.ndarray):
        m = np.unique(np.asarray(members, dtype=np.uint16))
        if len(m) * 2 <= SPAN // 8:
            self.sparse, self.packed = m, None
        else:
            flags = np.zeros(SPAN, dtype=bool)
            flags[m] = True
            self.sparse, self.packed = None, np.packbits(flags)

    def bits(self) -> np.ndarray:
        if self.packed is not None:
            return self.packed
        flags = np.zeros(SPAN, dtype=bool)
        flags[self.sparse] = True
        return np.packbits(flags)

    def members(self) -> np.ndarray:
        return self.sparse if self.sparse is not None else np.flatnonzero(np.unpackbits(self.packed)).astype(np.uint16)

    def and_not(self, other: "Container") -> np.ndarray:
        """Members of this and not of the other, ascending."""
        if self.sparse is not None and other.sparse is not None:
            return np.setdiff1d(self.sparse, other.sparse, assume_unique=True)
        return np.flatnonzero(np.unpackbits(self.bits() & ~other.bits())).astype(np.uint16)

    def intersect(self, other: "Container") -> np.ndarray:
        if self.sparse is not None and other.sparse is not None:
            return np.intersect1d(self.sparse, other.sparse, assume_unique=True)
        return np.flatnonzero(np.unpackbits(self.bits() & other.bits())).astype(np.uint16)

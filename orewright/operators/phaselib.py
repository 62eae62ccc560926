"""The wave encoding of a text, for the Arrow function of :mod:`code`."""

from __future__ import annotations

import numpy as np

#: The golden ratio and the bits of a character that count. Fixed values.
GOLDEN, BITS = 1.618033988749895, 16


def encode(text: str, dim: int) -> np.ndarray:
    """Each character adds, for each of its bits, a sine (bit 1) or half a cosine (bit 0) over
    the dimensions, weighed by 1 / (1 + place); the sum is centred and scaled to length 1."""
    out = np.zeros(dim)
    k = np.arange(dim)
    bits = np.arange(min(BITS, dim))
    for at in range(0, len(text), 256):
        codes = np.array([ord(c) for c in text[at : at + 256]])
        place = np.arange(at, at + len(codes))
        phase = place * 0.01 + np.mod(codes * GOLDEN, 2 * np.pi)
        angle = (1.0 + 0.3 * bits)[None, :, None] * k[None, None, :] + phase[:, None, None]
        one = ((codes[:, None] >> bits) & 1)[:, :, None] == 1
        out += (np.where(one, np.sin(angle), 0.5 * np.cos(angle)) / (1.0 + place)[:, None, None]).sum((0, 1))
    out -= out.mean() if dim else 0.0
    n = np.linalg.norm(out)
    return out / n if n else out

"""Discrete wavelet transforms by lifting, over the rows and columns of arrays of any size, with symmetric extension."""

from __future__ import annotations

import numpy as np

# Lifting steps and scale of the 9/7 transform.
ALPHA, BETA, GAMMA, DELTA = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971
SCALE = 1.230174104914001


def _neighbours(s: np.ndarray, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """For odd places: the even samples before and after each; the last is mirrored where there is none after."""
    right = s[..., 1:]
    if right.shape[-1] < n_out:
        right = np.concatenate([right, s[..., -1:]], -1)
    return s[..., :n_out], right[..., :n_out]


def _around(d: np.ndarray, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    """For even places: the odd samples before and after each, mirrored at the ends."""
    left = np.concatenate([d[..., :1], d], -1)[..., :n_out]
    right = d if d.shape[-1] >= n_out else np.concatenate([d, d[..., -1:]], -1)
    return left, right[..., :n_out]


def forward53(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high bands of integers along the last axis."""
    s, d = x[..., 0::2].astype(np.int64), x[..., 1::2].astype(np.int64)
    if not d.shape[-1]:
        return s, d
    a, b = _neighbours(s, d.shape[-1])
    d = d - (a + b >> 1)
    a, b = _around(d, s.shape[-1])
    return s + (a + b + 2 >> 2), d


def inverse53(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    out = np.empty((*s.shape[:-1], s.shape[-1] + d.shape[-1]), np.int64)
    if d.shape[-1]:
        a, b = _around(d, s.shape[-1])
        s = s - (a + b + 2 >> 2)
        a, b = _neighbours(s, d.shape[-1])
        d = d + (a + b >> 1)
    out[..., 0::2], out[..., 1::2] = s, d
    return out


def forward97(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, d = x[..., 0::2].astype(float), x[..., 1::2].astype(float)
    if not d.shape[-1]:
        return s, d
    for step, odd in ((ALPHA, True), (BETA, False), (GAMMA, True), (DELTA, False)):
        if odd:
            a, b = _neighbours(s, d.shape[-1])
            d = d + step * (a + b)
        else:
            a, b = _around(d, s.shape[-1])
            s = s + step * (a + b)
    return s / SCALE, d * SCALE


def inverse97(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    out = np.empty((*s.shape[:-1], s.shape[-1] + d.shape[-1]))
    if d.shape[-1]:
        s, d = s * SCALE, d / SCALE
        for step, odd in ((DELTA, False), (GAMMA, True), (BETA, False), (ALPHA, True)):
            if odd:
                a, b = _neighbours(s, d.shape[-1])
                d = d - step * (a + b)
            else:
                a, b = _around(d, s.shape[-1])
                s = s - step * (a + b)
    out[..., 0::2], out[..., 1::2] = s, d
    return out


def sizes(rows: int, cols: int, levels: int) -> list[tuple[int, int]]:
    """Sizes of the low band after 0, 1, ... levels."""
    out = [(rows, cols)]
    for _ in range(levels):
        r, c = out[-1]
        out.append(((r + 1) // 2, (c + 1) // 2))
    return out


def _both(x: np.ndarray, forward) -> np.ndarray:
    x = np.concatenate(forward(x), -1)
    return np.concatenate(forward(x.T), -1).T


def _back(x: np.ndarray, inverse) -> np.ndarray:
    half = (x.shape[0] + 1) // 2
    t = x.T
    x = inverse(t[..., :half], t[..., half:]).T
    half = (x.shape[1] + 1) // 2
    return inverse(x[..., :half], x[..., half:])


def transform(picture: np.ndarray, levels: int, reversible: bool = True) -> np.ndarray:
    """All levels in place: the low band of each level in the upper left corner."""
    out = picture.astype(np.int64 if reversible else float)
    for r, c in sizes(*picture.shape, levels)[:-1]:
        out[:r, :c] = _both(out[:r, :c], forward53 if reversible else forward97)
    return out


def restore(bands: np.ndarray, levels: int, reversible: bool = True) -> np.ndarray:
    out = bands.astype(np.int64 if reversible else float)
    for r, c in sizes(*bands.shape, levels)[-2::-1]:
        out[:r, :c] = _back(out[:r, :c], inverse53 if reversible else inverse97)
    return out if reversible else np.rint(out).astype(np.int64)

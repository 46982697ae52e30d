"""Hashes of runs of words or bytes in whole arrays, and the sparse places at which equal runs are found again."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two runs behind each other."""
    return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def run_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` units, by doubling."""
    n = len(units) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, at, power, width = None, 0, units, 1
    while True:
        if length & width:
            part = power[at : at + n]
            total = part if total is None else joined(total, part)
            at += width
        width *= 2
        if width > length:
            return total
        power = joined(power[: len(power) - width // 2], power[width // 2 :])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every window of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some ``window`` neighbouring ones: equal runs of hashes have equal anchors."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = sliding(hashes, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    best = sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    return np.flatnonzero(best == hashes)

"""Fingerprints against sums written out term by term."""

import numpy as np
import pytest

from sextant.llm.media import BLOCK, FAN, HOP, REACH, fingerprints


def plain(samples):
    n = BLOCK
    wave = [[np.exp(-2j * np.pi * f * k / n) for k in range(n)] for f in range(n // 2 + 1)]
    window = [0.5 - 0.5 * np.cos(2 * np.pi * k / (n - 1)) for k in range(n)]
    power = []
    for at in range(0, len(samples) - n + 1, HOP):
        frame = [float(x) - 128 for x in samples[at : at + n]]
        mean = sum(frame) / n
        own = [(x - mean) * w for x, w in zip(frame, window, strict=True)]
        power.append([abs(sum(x * y for x, y in zip(own, row, strict=True))) for row in wave])
    peaks = []
    for t, row in enumerate(power):
        mean = sum(row) / len(row)
        for f, x in enumerate(row):
            beside = [row[k] for k in (f - 1, f + 1) if 0 <= k < len(row)]
            around = [power[k][f] for k in (t - 1, t + 1) if 0 <= k < len(power)]
            if all(x > y for y in beside) and all(x >= y for y in around) and x > 2 * mean:
                peaks.append((t, f))
    found = []
    for i, (t, f) in enumerate(peaks):
        for u, g in peaks[i + 1 : i + 1 + FAN]:
            if u - t <= REACH:
                found.append(t << 32 | f << 16 | g << 8 | (u - t))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fingerprints_are_those_of_plain_sums(seed):
    r = np.random.default_rng(seed)
    k = np.arange(192 * 6)
    tones = 40 * np.sin(2 * np.pi * k * r.uniform(0.02, 0.2)) + 30 * np.sin(2 * np.pi * k * r.uniform(0.2, 0.45))
    samples = np.clip(128 + tones + r.normal(0, 6, len(k)), 0, 255).astype(np.uint8)
    found = fingerprints(samples).tolist()
    assert found == plain(samples) and found

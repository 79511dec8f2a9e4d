"""PCM fingerprints: envelopes of energy and zero crossings in quantised bins, for near-duplicate review."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wav import decode, probe_files

#: Source and fingerprint bins, bands, part of the peak that counts as sound, least bins with sound, analysed rate, levels.
ENVELOPE, BINS, BANDS, SOUND, LEAST_BINS, RATE, LEVELS = 256, 64, 8, 0.02, 8, 2000, 31


def _stretched(values: np.ndarray) -> np.ndarray:
    """``BINS`` evenly spaced points, as whole levels; halves go to the even level."""
    points = np.interp(np.linspace(0, len(values) - 1, BINS), np.arange(len(values)), values)
    return np.clip(np.rint(points * LEVELS), 0, LEVELS)


def fingerprint(content: bytes) -> dict[str, float]:
    """64 energy and 64 crossing levels (0 to 31) as fields e0.. and z0.., and the seconds of sound.

    Energy is the mean magnitude of the channels, relative to the loudest bin; crossings are by
    channel, a zero keeping the sign before it, relative to half the analysed rate.  Bins before and after
    the sound do not count.
    """
    samples, width, channels, rate = decode(content)
    x = samples.reshape(-1, channels) / (1 << (8 * width - 1))
    n = len(x)
    if not n:
        raise ValueError("no samples")
    seen = np.arange(0, n, max(1, rate // RATE))
    x = x[seen]
    sign = np.sign(x)
    held = np.maximum.accumulate(np.where(sign != 0, np.arange(len(x))[:, None], -1), axis=0)
    carried = np.where(held >= 0, np.take_along_axis(sign, np.maximum(held, 0), 0), 0)
    flips = np.zeros(len(x))
    flips[1:] = ((carried[1:] != carried[:-1]) & (carried[:-1] != 0)).mean(1)
    at = np.minimum(ENVELOPE - 1, seen * ENVELOPE // n)
    energy = np.bincount(at, np.abs(x).mean(1), ENVELOPE) / np.maximum(np.bincount(at, minlength=ENVELOPE), 1)
    peak = energy.max()
    if peak <= 0:
        raise ValueError("no sound")
    loud = np.flatnonzero(energy >= peak * SOUND)
    if len(loud) < LEAST_BINS:
        raise ValueError("too little sound")
    first, last = loud[0], loud[-1] + 1
    edges = np.arange(ENVELOPE + 1) * n // ENVELOPE
    seconds = np.diff(edges) / rate
    hertz = np.where(seconds > 0, np.bincount(at, flips, ENVELOPE) / np.where(seconds > 0, seconds, 1), 0)
    e, z = _stretched(energy[first:last] / peak), _stretched(np.minimum(1, hertz[first:last] / (RATE / 2)))
    return {f"e{i}": float(v) for i, v in enumerate(e)} | {f"z{i}": float(v) for i, v in enumerate(z)} | {"seconds": n / rate * (last - first) / ENVELOPE}


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, status, seconds, energy, zcr, bands, error_type, error) of the WAV files under ``path``.

    bands are coarse strings of 8 bins each, for a blocking join.
    """
    names = [f"{k}{i}" for k in "ez" for i in range(BINS)]
    raw = probe_files(spark, path, fingerprint, [*names, "seconds"])
    out = raw.select("path", "sha256", "status", "seconds", F.array(*names[:BINS]).alias("energy"), F.array(*names[BINS:]).alias("zcr"), "error_type", "error")
    return out.withColumn("bands", F.when(F.col("status") == "complete", band_hashes(F.col("energy"), F.col("zcr"))))


def band_hashes(energy, zcr):
    """e<a>:z<b> for each band: the means of its levels in quarters, halves to the even number."""
    width = BINS // BANDS

    def coarse(c, b: int):
        return F.bround(F.aggregate(F.slice(c, b * width + 1, width), F.lit(0.0), lambda s, v: s + v) / width / 4, 0).cast("int").cast("string")

    return F.array(*(F.concat(F.lit("e"), coarse(energy, b), F.lit(":z"), coarse(zcr, b)) for b in range(BANDS)))

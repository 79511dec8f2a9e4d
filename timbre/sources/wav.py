"""PCM WAV files: decoded in executors, probed with numpy, failures kept as rows."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.signal import FLOOR_MOST, FLOOR_PLACE, FLOOR_TIMES, LEAST_ACTIVE, PEAK_PART

MAX_BYTES = 512 << 20


def decode(content: bytes) -> tuple[np.ndarray, int, int, int]:
    """(samples as integers, interleaved; sample width; channels; rate) of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    if width == 1:
        return raw.astype(np.int64) - 128, width, channels, rate
    if width not in (2, 3, 4):
        raise ValueError(f"unsupported sample width: {width}")
    parts = raw[: len(raw) // width * width].reshape(-1, width).astype(np.int64)
    value = sum(parts[:, k] << (8 * k) for k in range(width))
    return np.where(value >= 1 << (8 * width - 1), value - (1 << (8 * width)), value), width, channels, rate


def level_probe(content: bytes, silence: float = 0.01, clipping: float = 0.999) -> dict[str, float]:
    """Duration, peak, rms, dc offset, silence and clipping of all interleaved samples, on the scale of the largest positive value."""
    samples, width, channels, rate = decode(content)
    if not len(samples):
        raise ValueError("no samples")
    x = samples / ((1 << (8 * width - 1)) - 1)
    size = np.abs(x)
    return {
        "audio_duration_seconds": len(x) / channels / rate, "sample_rate_hz": float(rate), "peak": float(size.max()), "rms": float(np.sqrt(np.mean(x * x))), "dc_offset": float(x.mean()),
        "silence_fraction": float((size <= silence).mean()), "clipping_fraction": float((size >= clipping).mean()),
    }


def _runs(mask: np.ndarray) -> list[tuple[int, int, bool]]:
    if not len(mask):
        return []
    at = np.flatnonzero(np.diff(mask.astype(np.int8))) + 1
    bounds = np.concatenate([[0], at, [len(mask)]])
    return [(int(a), int(b), bool(mask[a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: Proxies that a comparison of two recordings reports.
COMPARED = ("active_frame_fraction", "active_rms_db_std", "window_rms_db_std", "zero_crossing_rate_hz_std", "pause_rate_per_minute", "pause_fraction", "pause_duration_cv", "phrase_duration_cv")
#: Metrics that an observation carries, under prosody_<name>.
OBSERVED = (
    "active_frame_fraction", "active_rms_db_std", "analysis_duration_seconds", "eligible_for_long_form", "leading_inactive_seconds", "pause_duration_cv", "pause_fraction", "pause_rate_per_minute",
    "phrase_duration_cv", "trailing_inactive_seconds", "window_rms_db_std", "zero_crossing_rate_hz_std",
)
#: Active frames from which on a probe is complete.
LEAST_FRAMES = 5


def _db(x: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(x, 1e-12))


def _spread(name: str, values: np.ndarray, cv: bool = False) -> dict[str, float | None]:
    """Mean, population deviation and, with ``cv``, their quotient; null where there are too few values."""
    n, mean = len(values), float(values.mean()) if len(values) else None
    std = float(values.std()) if n >= 2 else None
    out = {f"{name}_mean": mean, f"{name}_std": std}
    return out | ({f"{name}_cv": std / mean if std is not None and mean > 0 else None} if cv else {})


def prosody_metrics(content: bytes, frame_ms: float = 40, hop_ms: float = 20, minimum_pause_ms: float = 120, window_seconds: float = 2, long_form_seconds: float = 30) -> dict[str, float | int | bool | None]:
    """Activity, pauses, phrases and level variation of a mono recording by overlapping frames."""
    if not 0 < hop_ms <= frame_ms or minimum_pause_ms < hop_ms or window_seconds <= 0 or long_form_seconds <= 0:
        raise ValueError("frames must be positive and no shorter than hops, and a pause at least one hop")
    samples, width, channels, rate = decode(content)
    if channels != 1:
        raise ValueError("prosody needs a mono recording")
    x = samples / ((1 << (8 * width - 1)) - 1)
    size, step, window = (max(1, round(v)) for v in (frame_ms * rate / 1000, hop_ms * rate / 1000, window_seconds * rate))
    if len(x) < size:
        raise ValueError("shorter than one frame")
    framed = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    rms = np.sqrt((framed * framed).mean(1))
    below = framed < 0
    crossings = (below[:, 1:] != below[:, :-1]).sum(1) * rate / size
    squares = np.add.reduceat(x * x, np.arange(0, len(x), window))
    held = np.minimum(window, len(x) - np.arange(0, len(x), window))
    windows = _db(np.sqrt(squares / held))[(held == window) | (held >= window // 2)]
    floor, peak = np.sort(rms)[min(len(rms) - 1, int(len(rms) * FLOOR_PLACE))], rms.max()
    threshold = max(LEAST_ACTIVE, min(floor * FLOOR_TIMES, peak * FLOOR_MOST), peak * PEAK_PART)
    active = rms > threshold
    at, hop, seconds = np.flatnonzero(active), step / rate, len(x) / rate
    pauses, phrases = [], []
    if len(at):
        spoken = active[at[0] : at[-1] + 1].copy()
        for a, b, on in _runs(spoken.copy()):
            if not on:
                spoken[a:b] = (b - a) * hop < minimum_pause_ms / 1000  # a short gap belongs to its phrase
        for a, b, on in _runs(spoken):
            (phrases if on else pauses).append((b - a) * hop)
    pauses, phrases = np.array(pauses), np.array(phrases)
    return {
        "analysis_duration_seconds": seconds, "sample_rate_hz": rate, "sample_width_bytes": width, "eligible_for_long_form": seconds >= long_form_seconds, "analyzed_frame_count": len(rms),
        "active_frame_count": len(at), "active_frame_fraction": len(at) / len(rms), "activity_threshold_dbfs": float(_db(threshold)), **_spread("active_rms_db", _db(rms[active])),
        "window_rms_db_std": _spread("w", windows)["w_std"], **_spread("zero_crossing_rate_hz", crossings[active]), "pause_count": len(pauses), "pause_rate_per_minute": len(pauses) * 60 / seconds,
        "pause_fraction": float(round(pauses.sum() / hop) / len(rms)), **_spread("pause_duration", pauses, True), "leading_inactive_seconds": float(at[0] * hop) if len(at) else seconds,
        "trailing_inactive_seconds": float((len(rms) - 1 - at[-1]) * hop) if len(at) else seconds, "phrase_count": len(phrases), **_spread("phrase_duration", phrases, True),
    }


def prosody_status(metrics: dict) -> str:
    return "complete" if metrics["active_frame_count"] >= LEAST_FRAMES else "insufficient_activity"


def prosody_difference(reference: bytes, candidate: bytes) -> dict[str, float | None]:
    """Candidate minus reference of the compared proxies; both must be complete."""
    a, b = prosody_metrics(reference), prosody_metrics(candidate)
    if {prosody_status(a), prosody_status(b)} != {"complete"}:
        raise ValueError(f"a comparison needs {LEAST_FRAMES} active frames on both sides")
    return {k: None if a[k] is None or b[k] is None else b[k] - a[k] for k in COMPARED}


def prosody_observation(content: bytes) -> dict[str, float | bool | None]:
    """The fields that an observation takes from a complete probe."""
    m = prosody_metrics(content)
    if prosody_status(m) != "complete":
        raise ValueError("insufficient_activity")
    return {f"prosody_{k}": m[k] for k in OBSERVED}


def probe_files(spark: SparkSession, path: str, probe: Callable[[bytes], dict], fields: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, sha256, status, <fields>, error_type, error) for each WAV under ``path``: one file at a time in a task."""
    kinds = [("path", pa.string()), ("sha256", pa.string()), ("status", pa.string()), *((f, pa.float64()) for f in fields), ("error_type", pa.string()), ("error", pa.string())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, content in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "content")), strict=True):
                row: dict = {"path": name, "status": "complete"}
                try:
                    if size > max_bytes:
                        raise ValueError(f"larger than {max_bytes} bytes")
                    row["sha256"] = hashlib.sha256(content).hexdigest()
                    row |= probe(content)
                except (OSError, ValueError, EOFError, wave.Error) as e:
                    row |= {"status": "failed", "error_type": type(e).__name__, "error": str(e)[:500] or type(e).__name__}
                yield pa.RecordBatch.from_arrays([pa.array([float(v) if isinstance(v := row.get(n), (bool, int)) else v], t) for n, t in kinds], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    ddl = "path string, sha256 string, status string, " + "".join(f"{f} double, " for f in fields) + "error_type string, error string"
    return files.select("path", "length", "content").mapInArrow(run, ddl)

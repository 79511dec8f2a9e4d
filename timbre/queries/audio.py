"""Synthetic recordings as PCM WAV bytes, probed in the executors that make them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.wav import level_probe, prosody_metrics

#: seconds and loudness of each stretch; silence is a pause
STRETCHES = [(0.6, 0.35), (0.25, 0.0), (0.7, 0.55), (0.35, 0.0), (0.5, 0.25)]


def recording(stretches: list[tuple[float, float]], low: float = 150.0, high: float = 400.0, rate: int = 22_050, width: int = 2) -> bytes:
    """A mono PCM recording: in each stretch a tone that glides from ``low`` to ``high`` hertz and back."""
    parts = []
    for seconds, level in stretches:
        t = np.linspace(0, 1, round(seconds * rate), endpoint=False)
        hertz = low + (high - low) * np.sin(np.pi * t) ** 2
        parts.append(level * np.sin(2 * np.pi * np.cumsum(hertz) / rate))
    levels = np.rint(np.concatenate(parts) * ((1 << (8 * width - 1)) - 1)).astype("<i4")
    data = (levels + 128).astype(np.uint8).tobytes() if width == 1 else levels.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, width, rate, 0, "NONE", ""))
        w.writeframes(data)
    return out.getvalue()


def wav_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording for each nation, its loudness set by the region; probed where the bytes are."""
    fields = ["audio_duration_seconds", "peak", "rms", "silence_fraction", "pause_count", "active_frame_fraction", "phrase_duration_cv", "zero_crossing_rate_hz_mean"]
    kinds = [("sample_id", pa.string()), *((f, pa.float64()) for f in fields), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, region in zip(batch.column("n_name").to_pylist(), batch.column("n_regionkey").to_pylist(), strict=True):
                row: dict = {"sample_id": name}
                try:
                    data = recording([(s, a * (1 - 0.1 * region)) for s, a in STRETCHES])
                    row |= level_probe(data) | prosody_metrics(data)
                except (ValueError, EOFError, wave.Error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])

    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_regionkey")
    out = nations.mapInArrow(run, "sample_id string, " + "".join(f"{f} double, " for f in fields) + "error string")
    return out.withColumns({f: F.round(f, 6) for f in fields})


QUERIES = {"wav_probe": wav_probe}

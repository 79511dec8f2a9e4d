"""Audio that observations name: located below a base folder, read, and held against the recorded digest."""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_fault(path):
    """Why a recorded path may not be followed: absent, absolute, or leaving the base folder; else null."""
    return F.when(path.isNull() | (F.trim(path) == ""), "audio_path_missing").when(path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "audio_path_absolute").when(path.rlike(r"(^|/)\.\.(/|$)"), "audio_path_leaves_base")


def verify_audio(spark: SparkSession, obs: DataFrame, base: str) -> DataFrame:
    """(sample_id, audio_path, sha256, fault) of valid observations: fault is null where the file is there and what was recorded.

    An empty file counts as missing: Spark's file source passes over it.  Files are hashed where they are read; one file that several rows name is read once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    files = files.select(F.substring_index("path", base.rstrip("/") + "/", -1).alias("f_path"), F.sha2("content", 256).alias("f_sha256"))
    own = obs.where("valid").select("sample_id", "audio_path", "audio_sha256").withColumn("path_fault", path_fault(F.col("audio_path")))
    out = own.join(files, own.audio_path == files.f_path, "left")
    fault = (
        F.when(F.col("path_fault").isNotNull(), F.col("path_fault")).when(F.col("f_path").isNull(), "audio_missing")
        .when(~F.col("f_sha256").eqNullSafe(F.col("audio_sha256")), "audio_differs")
    )
    return out.select("sample_id", "audio_path", F.col("f_sha256").alias("sha256"), fault.alias("fault"))


def probe_observations(spark: SparkSession, obs: DataFrame, base: str, probe: Callable[[bytes], dict], fields: list[str]) -> DataFrame:
    """Extractor results of a WAV probe: (sample_id, audio_sha256, status, <fields>, error_type, error) for each valid observation."""
    from .wav import probe_files

    checked = verify_audio(spark, obs, base)
    probed = probe_files(spark, base, probe, fields).withColumn("p_path", F.substring_index("path", base.rstrip("/") + "/", -1))
    out = checked.join(probed.drop("path", "sha256"), F.col("audio_path") == F.col("p_path"), "left")
    failed = F.col("fault").isNotNull()
    return out.select(
        "sample_id", F.col("sha256").alias("audio_sha256"), F.when(failed, "failed").otherwise(F.col("status")).alias("status"), *(F.when(~failed, F.col(f)).alias(f) for f in fields),
        F.when(failed, "AudioFault").otherwise(F.col("error_type")).alias("error_type"), F.when(failed, F.col("fault")).otherwise(F.col("error")).alias("error"),
    )


def stage_blind(review: list[tuple[str, str, str]], base: Path, target: Path) -> list[dict[str, str]]:
    """Copy (blind_id, audio_path, sha256) to neutral names below ``target``; a listening pack is a short list.

    A name that is there with the same bytes is left; with other bytes it is refused.
    """
    out = []
    for blind_id, audio_path, sha256 in review:
        source = (base / audio_path).resolve()
        if not source.is_relative_to(base.resolve()) or (base / audio_path).is_symlink():
            raise ValueError(f"audio lies outside its base: {audio_path}")
        if hashlib.sha256(source.read_bytes()).hexdigest() != sha256:
            raise ValueError(f"audio differs from its record: {audio_path}")
        name = f"blind_audio/{blind_id}{source.suffix}"
        to = target / name
        to.parent.mkdir(parents=True, exist_ok=True)
        if not to.exists():
            shutil.copyfile(source, to)
        if hashlib.sha256(to.read_bytes()).hexdigest() != sha256:
            raise ValueError(f"other bytes are staged as {name}")
        out.append({"blind_id": blind_id, "path": name, "sha256": sha256})
    return out


_MODELS: dict[str, object] = {}


def model_extractor(files: DataFrame, factory: Callable[[], Callable[[bytes], dict]], key: str, fields: dict[str, str]) -> DataFrame:
    """Run a model over ``files(sample_id, content)``: (sample_id, status, <fields>, error_type, error).

    ``factory`` makes the model once in each Python worker (say, a local speech
    recogniser or speaker encoder); a file that it cannot take is a failed row.
    """
    kinds = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "long": pa.int64()}
    names = ["sample_id", "status", *fields, "error_type", "error"]
    types = [pa.string(), pa.string(), *(kinds[t] for t in fields.values()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _MODELS:
            _MODELS[key] = factory()
        model = _MODELS[key]
        for batch in batches:
            for name, content in zip(batch.column("sample_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                row: dict = {"sample_id": name, "status": "complete"}
                try:
                    row |= model(content)  # type: ignore[operator]
                except Exception as e:
                    row |= {"status": "failed", "error_type": type(e).__name__, "error": str(e)[:500]}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, types, strict=True)], names=names)

    ddl = "sample_id string, status string, " + "".join(f"{n} {t}, " for n, t in fields.items()) + "error_type string, error string"
    return files.select("sample_id", "content").mapInArrow(run, ddl)

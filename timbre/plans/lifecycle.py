"""Lifecycle of an external backend: its stages run as child processes of the driver, one after the other."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import signal
import subprocess
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .checks import ContractViolation

STAGES = ("preflight", "training", "inference", "evaluation", "packaging")
GRACE_SECONDS = 5.0


@dataclass(frozen=True)
class Stage:
    """A stage's command, the files it must leave, and its time limit."""

    name: str
    argv: list[str]
    outputs: list[str] = field(default_factory=list)
    timeout: float = 3600.0


@dataclass(frozen=True)
class Backend:
    name: str
    adaptation_modes: tuple[str, ...]
    stages: tuple[Stage, ...]


def resolve(backends: list[Backend], mode: str) -> Backend:
    """The one backend for an adaptation mode."""
    found = [b for b in backends if mode in b.adaptation_modes]
    if len(found) != 1:
        raise ContractViolation(f"{len(found)} backends for {mode}")
    return found[0]


def validate_backend(backend: Backend) -> None:
    if [s.name for s in backend.stages] != [s for s in STAGES if s in {x.name for x in backend.stages}]:
        raise ContractViolation("stages are unknown, repeated or out of order")
    for s in backend.stages:
        if not s.argv or not all(isinstance(a, str) and a for a in s.argv) or s.timeout <= 0:
            raise ContractViolation(f"stage {s.name} has no usable command")
        if any(Path(o).is_absolute() or ".." in Path(o).parts for o in s.outputs):
            raise ContractViolation(f"stage {s.name} writes outside its run")


def _stop(process: subprocess.Popen) -> None:
    """End a stage's whole process group: ask first, then force."""
    for sig, wait in ((signal.SIGTERM, GRACE_SECONDS), (signal.SIGKILL, GRACE_SECONDS)):
        try:
            os.killpg(process.pid, sig)
        except ProcessLookupError:
            break
        until = time.monotonic() + wait
        while process.poll() is None and time.monotonic() < until:
            time.sleep(0.05)


def _digests(root: Path, outputs: list[str]) -> dict[str, str]:
    out = {}
    for name in outputs:
        path = root / name
        if path.is_symlink() or not path.is_file():
            raise ContractViolation(f"output is missing or no plain file: {name}")
        out[name] = hashlib.sha256(path.read_bytes()).hexdigest()
    return out


def run(backend: Backend, root: Path, env: dict[str, str] | None = None) -> list[dict]:
    """A row for each stage, failures included; the stages after a failure are "not_run".

    Before a stage is accepted, the outputs of all earlier ones must still be what they were.
    """
    validate_backend(backend)
    root.mkdir(parents=True, exist_ok=True)
    rows, held, failed = [], {}, False
    for stage in backend.stages:
        row = {"backend": backend.name, "stage": stage.name, "status": "not_run", "exit_code": None, "started": None, "ended": None, "error": None, "outputs": None}
        rows.append(row)
        if failed:
            continue
        row["started"] = dt.datetime.now(dt.UTC).isoformat()
        settings = os.environ | (env or {}) | {"RUN_ROOT": str(root), "RUN_STAGE": stage.name}
        try:
            with (root / f"{stage.name}.log").open("wb") as log:
                process = subprocess.Popen(stage.argv, cwd=root, env=settings, stdout=log, stderr=log, start_new_session=True)
                try:
                    row["exit_code"] = process.wait(stage.timeout)
                finally:
                    _stop(process)
            if row["exit_code"]:
                raise ContractViolation(f"exit code {row['exit_code']}")
            if _digests(root, list(held)) != held:
                raise ContractViolation("an earlier stage's output has changed")
            own = _digests(root, stage.outputs)
            held |= own
            row |= {"status": "complete", "outputs": json.dumps(own, sort_keys=True)}
        except (OSError, subprocess.TimeoutExpired, ContractViolation) as e:
            failed = True
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"}
        row["ended"] = dt.datetime.now(dt.UTC).isoformat()
    return rows


def report(spark: SparkSession, rows: list[dict]) -> DataFrame:
    schema = "backend string, stage string, status string, exit_code int, started string, ended string, error string, outputs string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

"""Run folders: their state, the policy for reusing them, and atomic writes of small driver-side files."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import time
from pathlib import Path

MANIFEST, STATUS, COMPLETE = "run_manifest.json", "run_status.json", "run_complete.json"


class RunStateError(RuntimeError):
    pass


def write_text(path: str | Path, text: str) -> Path:
    """Write beside the target, flush to disk, rename."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return path


def write_json(path: str | Path, value) -> Path:
    return write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def _read(path: Path) -> dict | None:
    try:
        found = json.loads(path.read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def state(folder: str | Path, outputs: tuple[str, ...] = ()) -> str:
    """missing, empty, partial, failed, cancelled, complete, legacy_complete or unknown."""
    folder = Path(folder)
    if not folder.exists():
        return "missing"
    if not any(folder.iterdir()):
        return "empty"
    if (folder / COMPLETE).exists():
        return "complete" if _read(folder / COMPLETE) is not None and all((folder / o).exists() for o in outputs) else "partial"
    status = (_read(folder / STATUS) or {}).get("status")
    if status in ("failed", "cancelled"):
        return status
    if status or (folder / MANIFEST).exists():
        return "partial"
    return "legacy_complete" if outputs and all((folder / o).exists() for o in outputs) else "unknown"


def prepare(folder: str | Path, configuration_hash: str, policy: str = "error", outputs: tuple[str, ...] = ()) -> str:
    """Reserve a folder: ``run`` or ``skip``. ``resume`` wants the same configuration; ``error`` a new or empty folder."""
    now = state(folder, outputs)
    if policy not in ("error", "resume", "overwrite"):
        raise RunStateError(f"unknown policy {policy}")
    if now not in ("missing", "empty"):
        if policy == "error":
            raise RunStateError(f"{folder} is {now}")
        if policy == "resume":
            held = _read(Path(folder) / MANIFEST) or {}
            if held.get("configuration_hash") != configuration_hash:
                raise RunStateError(f"{folder} was made with another configuration")
            if now == "complete":
                return "skip"
    for name in (COMPLETE, STATUS):
        (Path(folder) / name).unlink(missing_ok=True)
    write_json(Path(folder) / MANIFEST, {"configuration_hash": configuration_hash, "created": time.time()})
    write_json(Path(folder) / STATUS, {"status": "running"})
    return "run"


def finish(folder: str | Path, status: str = "complete", outputs: tuple[str, ...] = (), error: str | None = None) -> None:
    """Mark failed, cancelled, or complete; complete only if the outputs are there."""
    folder = Path(folder)
    if status == "complete":
        if missing := [o for o in outputs if not (folder / o).exists()]:
            raise RunStateError(f"outputs missing: {missing}")
        write_json(folder / COMPLETE, {"finished": time.time(), "outputs": list(outputs)})
    write_json(folder / STATUS, {"status": status, "error": error})


def metadata(spark, configuration: dict, **more) -> dict:
    from ..functions.scalars import stable_hash

    def git(*args):
        done = subprocess.run(["git", *args], capture_output=True, text=True)
        return done.stdout.strip() if done.returncode == 0 else None

    return {"configuration_hash": stable_hash(configuration), "configuration": configuration, "repository_commit": git("rev-parse", "HEAD"), "python": sys.version.split()[0], "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")} | more


def plan_jobs(jobs: list[dict], states: dict[str, str], policy: str = "resume") -> list[dict]:
    """Action of each job: run, skip, resume, reject or skip_missing_dep."""
    out = []
    for job in jobs:
        now = states.get(job["job_id"], "missing")
        if any(states.get(d, "missing") not in ("complete", "legacy_complete") for d in job.get("needs", [])):
            action = "skip_missing_dep"
        elif now in ("missing", "empty") or policy == "overwrite":
            action = "run"
        elif policy == "resume":
            action = "skip" if now == "complete" else "resume"
        else:
            action = "reject"
        out.append(job | {"state": now, "action": action})
    return out


def validate_outputs(folder: str | Path, tables: dict[str, tuple[list[str], int]] | None = None, documents: dict[str, list[str]] | None = None) -> list[str]:
    """Faults of driver-side outputs: CSV headers and least row counts, JSON documents and their keys."""
    import csv

    found = []
    for name, (columns, least) in (tables or {}).items():
        try:
            with open(Path(folder) / name, newline="") as lines:
                rows = csv.reader(lines)
                head = next(rows, [])
                n = sum(1 for _ in rows)
        except OSError:
            found.append(f"{name}: missing")
            continue
        if missing := [c for c in columns if c not in head]:
            found.append(f"{name}: lacks {', '.join(missing)}")
        if n < least:
            found.append(f"{name}: {n} rows, at least {least} wanted")
    for name, keys in (documents or {}).items():
        held = _read(Path(folder) / name)
        found += [f"{name}: unreadable"] if held is None else [f"{name}: lacks {k}" for k in keys if k not in held]
    return found


def inspect(folders: dict[str, str | Path], tables: dict[str, tuple[list[str], int]] | None = None, documents: dict[str, list[str]] | None = None) -> list[dict]:
    """State, faults of outputs and last error of each job's folder (job -> folder)."""
    out = []
    for job, folder in folders.items():
        held = state(folder)
        faults = validate_outputs(folder, tables, documents) if held == "complete" else []
        out.append({"job_id": job, "state": held, "ok": held == "complete" and not faults, "faults": faults, "error": (_read(Path(folder) / STATUS) or {}).get("error")})
    return out


def execute_jobs(jobs: list[dict], states: dict[str, str], run, policy: str = "resume", stop_at_failure: bool = False) -> list[dict]:
    """Runs the planned jobs in order inside this application; ``run(job)`` raises where it fails.

    A job whose dependency failed, or was not run, is skipped.
    """
    now, out = dict(states), []
    for job in jobs:
        plan = plan_jobs([job], now, policy)[0]
        if plan["action"] in ("run", "resume"):
            try:
                run(plan)
                now[job["job_id"]], plan = "complete", plan | {"result": "complete", "error": None}
            except Exception as failure:  # noqa: BLE001  any failure is the job's result
                now[job["job_id"]], plan = "failed", plan | {"result": "failed", "error": f"{type(failure).__name__}: {failure}"}
        out.append({"result": None, "error": None} | plan)
        if stop_at_failure and out[-1]["result"] == "failed":
            break
    return out


def status_counts(plans: list[dict]) -> dict[str, int]:
    out: dict[str, int] = {}
    for p in plans:
        out[p["state"]] = out.get(p["state"], 0) + 1
    return out


def file_fingerprint(path: str | Path) -> dict:
    """Size and SHA-256 of a driver-side file, read in blocks."""
    import hashlib

    digest, size = hashlib.sha256(), 0
    with open(path, "rb") as raw:
        while block := raw.read(1 << 20):
            digest.update(block)
            size += len(block)
    return {"path": str(path), "bytes": size, "sha256": digest.hexdigest()}


def comparison_manifest(folder: str | Path, inputs: list[str | Path], settings: dict) -> Path:
    """What a comparison read, byte for byte, and how it was set."""
    from ..functions.scalars import stable_hash

    return write_json(Path(folder) / "comparison_manifest.json", {"inputs": [file_fingerprint(p) for p in inputs], "settings": settings, "settings_hash": stable_hash(settings)})

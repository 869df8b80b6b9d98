"""Manifests, fingerprints, snapshots, lineage and reports: small documents made of small frames on the driver. A ledger of many
files stays a table, of which `fingerprint_of_table` takes the digest.

Documents go to local paths, or, where a session is given, to any path that Spark's file systems reach.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable
from .files import at_path, get_text, put_text

#: The versions that a manifest pins.
VERSIONS = {
    "alignment_version": "alignment_v1.yaml",
    "feature_builder_version": "v1",
    "windowing_version": "windowing_v1.yaml",
    "canonical_schema_version": "v1",
    "market_state_schema_version": "v1",
    "modality_registry": "modalities_v1.yaml",
}


def save_json(document: dict, path: str | Path, spark: SparkSession | None = None) -> None:
    text = json.dumps(document, indent=2)
    if spark:
        put_text(spark, str(path), text)
        return
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def load_json(path: str | Path, spark: SparkSession | None = None) -> dict | None:
    """A document; None if it is not there."""
    if spark:
        text = get_text(spark, str(path))
    else:
        text = Path(path).read_text() if Path(path).exists() else None
    return None if text is None else json.loads(text)


def ledger(files: DataFrame, symbols: list[str]) -> dict[str, str]:
    """file_id -> sha256 of the files of `symbols`. A row for each file; a catalogue is no data."""
    rows = files.filter(F.col("symbol").isin(symbols)).select("file_id", "sha256").distinct()
    return {r.file_id: r.sha256 for r in rows.collect()}


def build_manifest(snapshot: str, train: list[str], validation: list[str], test: list[str], train_end: str, seed: int = 42, files: DataFrame | None = None) -> dict[str, Any]:
    """A manifest. The names of its entries, as fingerprints of other tools are taken of them."""
    symbols = sorted({*train, *validation, *test})
    return {
        "training_manifest": {
            "dataset": {"snapshot": snapshot, **VERSIONS},
            "splits": {"train": {"symbols": train}, "validation": {"symbols": validation}, "test": {"symbols": test}, "time_split": {"train_end": train_end}},
            "random_seed": {"python": seed, "numpy": seed, "torch": seed},
            "file_ledger": ledger(files, symbols) if files is not None else {},
        }
    }


def fingerprint(manifest: dict) -> dict[str, Any]:
    """sha256 of the sorted ledger, a bar, and the sorted versions, both as JSON."""
    held = manifest.get("training_manifest", {})
    files, versions = held.get("file_ledger", {}), held.get("dataset", {})
    text = f"{json.dumps(files, sort_keys=True)}|{json.dumps(versions, sort_keys=True)}"
    return {"fingerprint": hashlib.sha256(text.encode()).hexdigest(), "file_count": len(files), "dataset_versions": versions}


#: Files whose names and digests are one piece of the text that a fingerprint is taken of.
PIECE_FILES = 50_000


def fingerprint_of_table(manifest: dict, files: DataFrame) -> dict[str, Any]:
    """As `fingerprint`, of a manifest whose ledger is the table `files` (symbol, file_id, sha256): those of the manifest's symbols.

    A SHA-256 is a chain, so its text must pass one place in order. Tasks sort the files by range and write the text of each range;
    the driver takes these one after another, and holds one of some PIECE_FILES files at a time. File ids are not null; of
    several digests of one file the largest counts.
    """
    held = manifest["training_manifest"]
    symbols = sorted({s for split in held["splits"].values() for s in split.get("symbols", ())})
    rows = durable(files.filter(F.col("symbol").isin(symbols)).groupBy("file_id").agg(F.max("sha256").alias("sha256")))
    count = rows.count()

    def written(batches):
        import pyarrow as pa

        for batch in batches:
            items = zip(batch.column("file_id").to_pylist(), batch.column("sha256").to_pylist(), strict=True)
            text = ", ".join(f"{json.dumps(name)}: {json.dumps(sha)}" for name, sha in items)
            yield pa.RecordBatch.from_arrays([pa.array([text.encode()], pa.binary())], names=["text"])

    texts = durable(rows.repartitionByRange(max(1, -(-count // PIECE_FILES)), "file_id").sortWithinPartitions("file_id").mapInArrow(written, "text binary").filter(F.octet_length("text") > 0))
    digest, between = hashlib.sha256(b"{"), b""
    for row in texts.toLocalIterator():
        digest.update(between + bytes(row.text))
        between = b", "
    digest.update(f"}}|{json.dumps(held['dataset'], sort_keys=True)}".encode())
    return {"fingerprint": digest.hexdigest(), "file_count": count, "dataset_versions": held["dataset"]}


def create_snapshot(folder: str | Path, name: str, manifest: dict, checksums: dict | None = None, statistics: dict | None = None, spark: SparkSession | None = None) -> str | Path:
    """Writes an immutable snapshot and its content hash, which comes last; one of that name is a FileExistsError. Checksums are the
    manifest's ledger if none are given, or only a status."""
    target = f"{folder}/{name}" if spark else Path(folder) / name
    fs, at = at_path(spark, target) if spark else (None, None)
    if fs.exists(at) if spark else target.exists():
        raise FileExistsError(target)
    if checksums is None or "status" in checksums:
        checksums = manifest.get("training_manifest", {}).get("file_ledger", {})
    content = {"manifest": manifest, "checksums": checksums, "statistics": statistics or {}}
    digest = hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()
    for part, value in content.items():
        save_json(value, f"{target}/{part}.json", spark)
    save_json({"name": name, "sha256": digest, "created_at": datetime.now(UTC).isoformat()}, f"{target}/snapshot.json", spark)
    return target


def record_stage(path: str | Path, stage: str, entry: dict, spark: SparkSession | None = None) -> dict[str, list]:
    """Adds an entry to a stage of a lineage document."""
    held = load_json(path, spark) or {}
    held.setdefault(stage, []).append({"recorded_at": datetime.now(UTC).isoformat(), **entry})
    save_json(held, path, spark)
    return held


def dataset_version(name: str, version: str, files: DataFrame) -> dict[str, Any]:
    from .catalog import storage_summary

    row = storage_summary(files).first()
    return {"dataset": name, "version": version, "created_at": datetime.now(UTC).isoformat(), "file_count": row.file_count, "total_rows": row.total_rows, "total_bytes": row.total_bytes}


def markdown(frame: DataFrame, title: str, limit: int = 1000) -> str:
    """A small frame as a Markdown table; numbers with thousands separators."""
    def text(x) -> str:
        return "" if x is None else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)

    rows = frame.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(frame.columns) + " |", "|" + " --- |" * len(frame.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(text, r)) + " |" for r in rows)]) + "\n"


def data_card(name: str, manifest: dict, summary: DataFrame) -> str:
    held = manifest["training_manifest"]
    splits = "\n".join(f"- {k}: {', '.join(v['symbols'])}" for k, v in held["splits"].items() if "symbols" in v)
    return f"# {name}\n\nSnapshot {held['dataset']['snapshot']}, {len(held['file_ledger'])} files, train until {held['splits']['time_split']['train_end']}.\n\n{splits}\n\n{markdown(summary, 'Storage')}"


def latest_run(base: str | Path, manifest: str = "run.json") -> Path | None:
    """The run that a manifest in `base` names, or else the newest folder."""
    base = Path(base)
    if (base / manifest).exists():
        return base / json.loads((base / manifest).read_text())["run"]
    runs = [p for p in base.glob("*") if p.is_dir()]
    return max(runs, key=lambda p: p.stat().st_mtime, default=None)


def checkpoint_name(run: str | Path) -> Path | None:
    """best, else latest, else the last by name."""
    run = Path(run)
    for name in ("best", "latest"):
        if found := sorted(run.glob(f"{name}*")):
            return found[-1]
    return max(run.glob("*.pt"), default=None)


def cache_key(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:20]

"""Project documents and the registry: JSON files, one document each."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.config import FOLDER

BROKEN = "_corrupt"


def scan(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Documents of the given files, one a file or one a line; what can't be parsed is an error."""
    return spark.read.option("multiLine", not lines).option("mode", "FAILFAST").schema(schemas.THREAD).json(paths)


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all projects below a storage root; broken files, and those without required fields, are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).schema(f"{schemas.THREAD}, {BROKEN} string").json(f"{root}/projects/*/thread.json")
    good = rows.where(F.col(BROKEN).isNull() & F.col("project_path").isNotNull() & F.col("facts").isNotNull() & F.col("sessions").isNotNull() & F.col("metadata").isNotNull())
    return good.drop(BROKEN)


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, name, last_known_path, last_seen)."""
    rows = spark.read.option("multiLine", True).schema(schemas.REGISTRY).json(path)
    return rows.select(F.explode("projects").alias("project_id", "p")).select("project_id", "p.*")


def normalised(threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of projects, facts and sessions; `ord` keeps the order of a document's arrays."""
    project = F.coalesce(F.col("project_hash"), F.md5("project_path")).alias("project_id")
    projects = threads.select(project, "project_path", "architecture", "state", "created_at", "updated_at")
    facts = threads.select(project, F.posexplode("facts").alias("ord", "f")).select("project_id", F.col("ord").cast("long").alias("ord"), F.col("f.id").alias("fact_id"), *(f"f.{c}" for c in ("session_id", "content", "category", "confidence", "created_at", "updated_at", "embedding", "utility", "context_window", "access_count", "last_used_at")))
    sessions = threads.select(project, F.posexplode("sessions").alias("ord", "s")).select("project_id", F.col("ord").cast("long").alias("ord"), F.col("s.id").alias("session_id"), F.col("s.summary").alias("summary"), F.size("s.fact_ids").cast("long").alias("facts_count"), F.col("s.created_at").alias("created_at"))
    return projects, facts, sessions


def write_tables(projects: DataFrame, facts: DataFrame, sessions: DataFrame, root: str) -> None:
    """Normalised tables; only the projects that are in the frames are overwritten."""
    for name, rows in (("projects", projects), ("facts", facts), ("sessions", sessions)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{root}/{name}") for name in ("projects", "facts", "sessions"))


class SearchLog:
    """Searches that await feedback: a line of JSON each, so that they outlive the process."""

    def __init__(self, path: Path):
        self.path = path

    def append(self, record: dict) -> None:
        with self.path.open("a") as file:
            file.write(json.dumps(record) + "\n")

    def records(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines() if x.strip()] if self.path.exists() else []

    def remove(self, ids: set[str]) -> None:
        """All other records stay; the file is replaced as a whole."""
        rest = [r for r in self.records() if r["search_id"] not in ids]
        new = self.path.with_suffix(".new")
        new.write_text("".join(json.dumps(r) + "\n" for r in rest))
        new.replace(self.path)


class Store:
    """Document storage: a project's own folder, or a shared root by the path's key.

    Documents are written by the driver and searched by all tasks: on a cluster, folders that all see (a shared mount).
    """

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)

    def local_dir(self, path: str) -> Path:
        return Path(path) / FOLDER

    def global_dir(self, path: str) -> Path:
        return self.root / "projects" / hashlib.md5(path.encode()).hexdigest()

    def _load(self, path: Path) -> dict | None:
        return json.loads(path.read_text()) if path.exists() else None

    def _save(self, path: Path, value: dict) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(value, indent=2, ensure_ascii=False))

    def load_thread(self, path: str) -> dict | None:
        """The project's own document first, else the shared one."""
        found = self._load(self.local_dir(path) / "thread.json")
        return found if found is not None else self._load(self.global_dir(path) / "thread.json")

    def thread_file(self, path: str) -> Path | None:
        return next((f for d in (self.local_dir(path), self.global_dir(path)) if (f := d / "thread.json").exists()), None)

    def save_thread(self, thread: dict, use_local: bool) -> bool:
        """Writes the whole document, locally if asked or if the project has its own folder, and registers the project; tells where."""
        path = thread["project_path"]
        local = use_local or self.local_dir(path).is_dir()
        place = self.local_dir(path) if local else self.global_dir(path)
        self._save(place / "thread.json", thread)
        meta = self._load(place / "meta.json") or {"project_id": str(uuid.uuid4()), "project_name": Path(path).name or "unknown", "created_at": now()}
        self._save(place / "meta.json", meta)
        self.register(meta["project_id"], meta["project_name"], path)
        return local

    def load_meta(self, path: str) -> dict | None:
        found = self._load(self.local_dir(path) / "meta.json")
        return found if found is not None else self._load(self.global_dir(path) / "meta.json")

    def load_registry(self) -> dict:
        return self._load(self.root / "registry.json") or {"version": 1, "projects": {}}

    def save_registry(self, registry: dict) -> None:
        self._save(self.root / "registry.json", registry)

    def register(self, project_id: str, name: str, path: str) -> None:
        registry = self.load_registry()
        registry["projects"][project_id] = {"name": name, "last_known_path": path, "last_seen": now()}
        self.save_registry(registry)

    def fix_path(self, path: str) -> None:
        """A project that was found at another path than the registry has moves there; one that it lacks is added."""
        meta = self.load_meta(path)
        if meta:
            known = self.load_registry()["projects"].get(meta["project_id"])
            if known is None or known["last_known_path"] != path:
                self.register(meta["project_id"], meta["project_name"], path)

    def searchable(self, stored: list[str]) -> tuple[list[str], list[str]]:
        """Paths of the registry's projects and of stored documents whose folder exists, and of the others."""
        paths = [p["last_known_path"] for p in self.load_registry()["projects"].values()]
        paths = list(dict.fromkeys(paths + sorted(stored)))
        return [p for p in paths if Path(p).is_dir()], [p for p in paths if not Path(p).is_dir()]


def now() -> str:
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")

"""The three tools: save a conversation's context, load it, search it.

Documents are kept by `Store`; every search is one Spark plan over the documents' facts, for one project or for all of them.  What a save
states becomes facts by the same operators that work on whole tables.  Embeddings are cached, searches logged on disk; feedback is
learned from them by a thread of its own, after the answer.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.config import EngineConfig
from factloom.functions.embedding import QUERY_PREFIX, Embedder, HashingEmbedder
from factloom.operators import feedback, ingest, search
from factloom.operators.rerank import Reranker, encode_posterior, try_load
from factloom.sources import documents
from factloom.sources.documents import SearchLog, Store, now
from factloom.sources.vectors import CachedEmbedder

log = logging.getLogger(__name__)


class ToolError(ValueError):
    """Wrong arguments."""


def strings(value: object) -> list[str]:
    """The strings of a JSON array; anything else counts as none."""
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def required(args: dict, name: str) -> str:
    value = args.get(name)
    if not isinstance(value, str):
        raise ToolError(f"the argument {name!r} has to be a string")
    return value


def limit_of(args: dict, default: int) -> int:
    """A whole number from 0 on, else the default."""
    value = args.get("limit")
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path, config: EngineConfig | None = None, embedder: Embedder | None = None):
        self.spark, self.config, self.store = spark, config or EngineConfig(), Store(root)
        own = embedder or HashingEmbedder()
        self.embedder = CachedEmbedder(own, Path(root) / f"embeddings-{getattr(own, 'dimension', 'model')}.bin")
        self.posterior_path = Path(root) / "posterior.bin"
        self.model: Reranker | None = try_load(self.config.bll_weights_path, self.posterior_path) if self.config.bll_enabled and self.config.bll_weights_path else None
        self.searches = SearchLog(Path(root) / "searches.jsonl")
        self.lock = threading.Lock()
        self.learner, self.learning = ThreadPoolExecutor(max_workers=1), Future()
        self.learning.set_result(None)
        self.tools: dict[str, Callable[[dict], dict]] = {"save_thread": self.save_thread, "load_thread": self.load_thread, "search_memory": self.search_memory}

    # Saving

    def save_thread(self, args: dict) -> dict:
        path, use_local = required(args, "project_path"), args.get("use_local_storage") if isinstance(args.get("use_local_storage"), bool) else True
        with self.lock:
            at = now()
            thread = self.store.load_thread(path) or {"project_path": path, "project_hash": documents.hashlib.md5(path.encode()).hexdigest(), "created_at": at, "updated_at": at, "architecture": None, "state": {"completed": [], "in_progress": [], "pending": []}, "facts": [], "sessions": [], "metadata": {}}
            if isinstance(args.get("architecture"), str):
                thread["architecture"] = args["architecture"]
            if "state" in args:  # replaced as a whole, also by a part or null
                given = args["state"] if isinstance(args["state"], dict) else {}
                thread["state"] = {k: strings(given.get(k)) for k in ("completed", "in_progress", "pending")}
            summary = args.get("summary") if isinstance(args.get("summary"), str) else ""
            said = self.stated(args)
            try:
                vectors = self.embedder.embed([f["content"] for f in said]) if said else []
            except Exception:
                log.exception("no embeddings for this save")
                vectors = [None] * len(said)
            session = str(uuid.uuid4())
            new = []
            for f, vector in zip(said, vectors, strict=True):
                fact = {"id": str(uuid.uuid4()), "content": f["content"], "category": f["category"], "confidence": 1.0, "created_at": at, "updated_at": at, "utility": {"alpha": 1.0, "beta": 1.0, "decay_rate": 0.0}, "access_count": 0, "context_window": f["context_window"], "session_id": session}
                new.append(fact | ({"embedding": list(vector)} if vector is not None else {}))
            thread["facts"] += new
            thread["sessions"].append({"id": session, "summary": summary, "fact_ids": [f["id"] for f in new], "created_at": at})
            thread["updated_at"] = at
            self.store.save_thread(thread, use_local)
        self.learning = self.learner.submit(self.learn, path)
        # the location is the one that was asked for, though a project with a folder of its own is stored there
        return {"success": True, "project_path": path, "storage_location": "local" if use_local else "global", "facts_saved": len(new), "total_facts": len(thread["facts"]), "total_sessions": len(thread["sessions"])}

    def stated(self, args: dict) -> list[dict]:
        """The facts of a save call, in order."""
        decided = [(i, x["decision"], x["reason"] if isinstance(x.get("reason"), str) else None) for i, x in enumerate(args["decisions"] if isinstance(args.get("decisions"), list) else []) if isinstance(x, dict) and isinstance(x.get("decision"), str)]
        stated = list(enumerate(strings(args.get("facts"))))
        if not decided and not stated:
            return []
        decisions = self.spark.createDataFrame([("call", *x) for x in decided], "call_id string, pos int, decision string, reason string")
        statements = self.spark.createDataFrame([("call", *x) for x in stated], "call_id string, pos int, content string")
        rows = ingest.facts(ingest.decisions(decisions), statements, self.config.context_window_size)
        return [r.asDict() for r in sorted(rows.collect(), key=lambda r: r.ord)]

    def settle(self) -> None:
        """Waits until the feedback of the last save is learned."""
        self.learning.result()

    def learn(self, path: str) -> None:
        """Feedback from earlier searches of this project; other projects' searches stay for their own save.

        Searches leave the log when they are learned from, or where there is no model to learn; a failure leaves them for the next save.
        """
        try:
            with self.lock:
                own = [s for s in self.searches.records() if s["project_path"] == path]
            if self.model is not None and own:
                self.learn_from(path, own)
            if own:
                with self.lock:
                    self.searches.remove({s["search_id"] for s in own})
        except Exception:
            log.exception("feedback was not taken over")

    def learn_from(self, path: str, own: list[dict]) -> None:
        _, facts, _ = documents.normalised(documents.scan(self.spark, [str(self.store.thread_file(path))]))
        key = documents.hashlib.md5(path.encode()).hexdigest()
        rows = self.spark.createDataFrame([(s["search_id"], key, s["query_embedding"], s["returned_fact_ids"]) for s in own], "search_id string, project_id string, query_embedding array<float>, returned_fact_ids array<string>")
        model = feedback.learned(rows, facts, self.model)
        if model.updates > self.model.updates:
            self.model = model
            self.posterior_path.write_bytes(encode_posterior(model))

    # Loading

    def load_thread(self, args: dict) -> dict:
        path = required(args, "project_path")
        with self.lock:
            self.store.fix_path(path)
            t = self.store.load_thread(path)
        if t is None:
            return {"success": False, "project_path": path}
        recent = [{"summary": s["summary"], "facts_count": len(s["fact_ids"]), "created_at": s["created_at"]} for s in t["sessions"][::-1][:5]]
        decided = [f["content"] for f in t["facts"][::-1] if f["category"] == schemas.DECISION][:10]
        return {"success": True, "project_path": path, "thread": {"architecture": t["architecture"], "state": t["state"], "recent_sessions": recent, "recent_decisions": decided, "total_facts": len(t["facts"]), "total_sessions": len(t["sessions"]), "created_at": t["created_at"], "updated_at": t["updated_at"]}}

    # Searching

    def search_memory(self, args: dict) -> dict:
        text, limit = required(args, "query"), limit_of(args, self.config.search_limit)
        vector = self.embedder.embed([QUERY_PREFIX + text])[0]
        path = args.get("project_path")
        return self.search_one(path, text, vector, limit) if isinstance(path, str) else self.search_all(text, vector, limit)

    def hits(self, facts: DataFrame, text: str, vector: list[float], limit: int) -> DataFrame:
        c = self.config
        return search.hybrid(facts, vector, text, limit, c.min_similarity, self.model, c.utility_lambda, english=True)

    def search_one(self, path: str, text: str, vector: list[float], limit: int) -> dict:
        with self.lock:
            file = self.store.thread_file(path)
            if file is None:
                return {"success": False, "message": f"nothing is saved for {path}"}
            _, facts, sessions = documents.normalised(documents.scan(self.spark, [str(file)]))
            rows = search.results(self.hits(facts, text, vector, limit), facts, sessions).orderBy("rank").drop("rank", "project_id").toJSON().collect()
            found = [_filled(documents.json.loads(r), ("session_summary",)) for r in rows]
            ids = [r["fact_id"] for r in found]
            thread, at = self.store.load_thread(path), now()
            for f in thread["facts"]:
                if f["id"] in ids:
                    f |= {"access_count": f["access_count"] + 1, "last_used_at": at}
            if ids:
                file.write_text(documents.json.dumps(thread, indent=2, ensure_ascii=False))
            self.searches.append({"search_id": str(uuid.uuid4()), "project_path": path, "ts": at, "query_embedding": list(vector), "returned_fact_ids": ids})
        return {"success": True, "query": text, "project_path": path, "results": found}

    def search_all(self, text: str, vector: list[float], limit: int) -> dict:
        shared = documents.scan_directory(self.spark, str(self.store.root)) if any(self.store.root.glob("projects/*/thread.json")) else None
        valid, invalid = self.store.searchable([r.project_path for r in shared.select("project_path").collect()] if shared is not None else [])
        files = [str(f) for p in valid if (f := self.store.local_dir(p) / "thread.json").exists()]
        threads = documents.scan(self.spark, files) if files else None
        if shared is not None:  # documents that their project has not in its own folder
            wanted = self.spark.createDataFrame([(p,) for p in valid if not (self.store.local_dir(p) / "thread.json").exists()], "project_path string")
            shared = shared.join(wanted, "project_path", "left_semi")
            threads = shared if threads is None else threads.unionByName(shared)
        found = []
        if threads is not None:
            projects, facts, sessions = documents.normalised(threads)
            hits = search.across(self.hits(facts, text, vector, limit), limit)
            rows = search.results_across(hits, facts, sessions, projects).orderBy(F.desc(F.round("score", 9)), "project_path").toJSON().collect()
            found = [_filled(documents.json.loads(r), ("session_summary",)) for r in rows]
        out = {"success": True, "query": text, "searched_projects": len(valid), "results": found}
        return out | ({"invalid_projects": invalid} if invalid else {})


def _filled(row: dict, names: tuple[str, ...]) -> dict:
    """With nulls for the fields that JSON rows leave out."""
    return dict.fromkeys(names) | row

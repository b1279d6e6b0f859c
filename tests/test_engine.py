"""Documents, the three tools and the server."""

import io
import json

import pytest

from factloom import config
from factloom.engine import Engine, limit_of
from factloom.operators import catalog, ingest
from factloom.operators.rerank import encode
from factloom.server import Server
from factloom.sources import documents
from factloom.sources.documents import Store
from factloom.sources.vectors import CachedEmbedder
from tests.test_retrieval import fixture


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, tmp_path / "root")


def save(engine, path, **more):
    return engine.save_thread({"project_path": str(path), "summary": "did it", **more})


def test_store_round_trips(tmp_path):
    store = Store(tmp_path / "root")
    thread = {"project_path": "/test/project", "facts": [], "sessions": [], "metadata": {}}
    assert store.load_thread("/test/project") is None
    assert store.save_thread(thread, False) is False and store.load_thread("/test/project") == thread
    (tmp_path / "p").mkdir()
    local = thread | {"project_path": str(tmp_path / "p")}
    assert store.save_thread(local, True) and (tmp_path / "p" / config.FOLDER / "meta.json").exists()
    assert store.save_thread(local, False)  # its own folder is there
    assert len(store.load_registry()["projects"]) == 2
    store.save_registry({"version": 1, "projects": {}})
    for i in (1, 2):
        store.register(f"id{i}", f"Project {i}", f"/path/to/project{i}")
    assert store.load_registry()["projects"]["id1"]["name"] == "Project 1"


def test_save_and_load(engine, tmp_path):
    decisions = [{"decision": "Use X", "reason": "fast"}, {"decision": " use x ", "reason": "dup"}, {"decision": ""}, {"decision": "Keep Y", "reason": " "}, {"decision": "Keep Z"}, {"no": 1}, "bad"]
    out = save(engine, tmp_path, decisions=decisions, facts=["one", 2, ""], architecture="layers", state={"completed": ["a", 1]})
    assert out["facts_saved"] == 5 and out["total_sessions"] == 1 and out["storage_location"] == "local"
    t = engine.load_thread({"project_path": str(tmp_path)})["thread"]
    assert t["recent_decisions"] == ["Keep Z", "Keep Y", "Use X (Reason: fast)"]
    assert t["state"] == {"completed": ["a"], "in_progress": [], "pending": []} and t["recent_sessions"][0]["facts_count"] == 5
    facts = engine.store.load_thread(str(tmp_path))["facts"]
    assert facts[0]["context_window"] == ["Keep Y", "Keep Z"] and facts[3]["context_window"] == ["Keep Y", "Keep Z", ""]
    save(engine, tmp_path, state=None)
    assert engine.load_thread({"project_path": str(tmp_path)})["thread"]["state"]["completed"] == []
    assert engine.load_thread({"project_path": "/nowhere"}) == {"success": False, "project_path": "/nowhere"}


def test_search(spark, tmp_path):
    (tmp_path / "w").write_bytes(encode(fixture(2, 64)))
    engine = Engine(spark, tmp_path / "root", config.EngineConfig(bll_weights_path=str(tmp_path / "w"), bll_enabled=False))
    for name in "ab":
        (tmp_path / name).mkdir()
        save(engine, tmp_path / name, facts=[f"the {name} project uses green paint", "cats sleep", "rain falls"])
    one = engine.search_memory({"query": "green paint", "project_path": str(tmp_path / "a"), "limit": 2})
    assert one["results"][0]["content"].startswith("the a project") and one["results"][0]["session_summary"] == "did it" and one["results"][0]["access_count"] == 0
    again = engine.search_memory({"query": "green paint", "project_path": str(tmp_path / "a")})
    assert again["results"][0]["access_count"] == 1
    both = engine.search_memory({"query": "green paint", "limit": 3})
    assert both["searched_projects"] == 2 and {r["project_path"] for r in both["results"]} == {str(tmp_path / "a"), str(tmp_path / "b")} and "fact_id" not in both["results"][0]
    assert engine.search_memory({"query": "x", "project_path": "/none"})["success"] is False
    engine.store.register("gone", "gone", "/no/such/dir")
    assert engine.search_memory({"query": "green", "limit": 0}) | {"results": []} == {"success": True, "query": "green", "searched_projects": 2, "results": [], "invalid_projects": ["/no/such/dir"]}
    assert len(engine.searches.records()) == 2


def test_feedback_on_save(spark, tmp_path):
    (tmp_path / "w").write_bytes(encode(fixture(2, 64)))
    engine = Engine(spark, tmp_path / "root", config.EngineConfig(bll_weights_path=str(tmp_path / "w")))
    save(engine, tmp_path, facts=["green paint", "blue paint"])
    engine.search_memory({"query": "paint", "project_path": str(tmp_path)})
    engine.searches.append({"search_id": "s", "project_path": "/other", "query_embedding": [0.0] * 64, "returned_fact_ids": ["x"]})
    engine = Engine(spark, tmp_path / "root", engine.config)  # the log outlives the process
    save(engine, tmp_path, facts=["more"])
    engine.settle()
    assert engine.model.updates == 2 and engine.posterior_path.exists() and [s["project_path"] for s in engine.searches.records()] == ["/other"]
    assert Engine(spark, tmp_path / "root", engine.config).model.updates == 2


def test_failed_feedback_stays_in_the_log(spark, tmp_path, monkeypatch):
    (tmp_path / "w").write_bytes(encode(fixture(2, 64)))
    engine = Engine(spark, tmp_path / "root", config.EngineConfig(bll_weights_path=str(tmp_path / "w")))
    engine.searches.append({"search_id": "s", "project_path": str(tmp_path), "query_embedding": [0.0] * 64, "returned_fact_ids": ["x"]})
    monkeypatch.setattr(engine, "learn_from", lambda *a: 1 / 0)
    assert save(engine, tmp_path, facts=["x"])["success"]
    engine.settle()
    assert len(engine.searches.records()) == 1


def test_location_is_the_one_asked_for(engine, tmp_path):
    save(engine, tmp_path, facts=["x"])
    assert save(engine, tmp_path, use_local_storage=False)["storage_location"] == "global"
    assert (tmp_path / config.FOLDER / "thread.json").exists()


def test_cached_embedder(tmp_path):
    asked = []

    class Model:
        dimension = 2

        def embed(self, texts):
            asked.extend(texts)
            return [[float(len(t)), 1.0] for t in texts]

    path = tmp_path / "c" / "cache.bin"
    first = CachedEmbedder(Model(), path)
    assert first.embed(["one", "three", "one"]) == [[3.0, 1.0], [5.0, 1.0], [3.0, 1.0]] and first.embed(["three"]) == [[5.0, 1.0]] and asked == ["one", "three"]
    path.write_bytes(path.read_bytes() + b"partial")
    again = CachedEmbedder(Model(), path)
    assert again.embed(["one", "fourth"]) == [[3.0, 1.0], [6.0, 1.0]] and asked == ["one", "three", "fourth"] and path.stat().st_size == 3 * 24
    (tmp_path / "dir").mkdir()
    assert CachedEmbedder(Model(), tmp_path / "dir").embed(["x"]) == [[1.0, 1.0]]


@pytest.mark.parametrize("given, expected", [(3, 3), (0, 0), (-1, 5), (2.5, 5), ("7", 5), (None, 5), (True, 5)])
def test_limit(given, expected):
    assert limit_of({"limit": given}, 5) == expected


def test_directory_scan_skips_broken_files(spark, engine, tmp_path):
    save(engine, "/p/one", use_local_storage=False, facts=["a", "b"])
    for name, content in (("bad", "{ not json"), ("poor", "{}")):
        (tmp_path / "root/projects" / name).mkdir()
        (tmp_path / "root/projects" / name / "thread.json").write_text(content)
    threads = documents.scan_directory(spark, str(tmp_path / "root"))
    projects, facts, sessions = documents.normalised(threads)
    assert (projects.count(), facts.count(), sessions.count()) == (1, 2, 1)
    assert documents.scan_registry(spark, str(tmp_path / "root/registry.json")).count() == 1
    documents.write_tables(projects, facts, sessions, str(tmp_path / "tables"))
    documents.write_tables(projects, facts, sessions, str(tmp_path / "tables"))
    assert [t.count() for t in documents.read_tables(spark, str(tmp_path / "tables"))] == [1, 2, 1]
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        documents.scan(spark, [str(tmp_path / "root/projects/bad/thread.json")]).collect()
    assert catalog.overview(projects, facts, sessions).first().total_facts == 2
    assert len(ingest.session_facts(facts).first().fact_ids) == 2
    assert sorted(r.ord for r in ingest.appended(facts.select("project_id", "ord"), facts.select("project_id", "ord")).collect()) == [0, 1, 2, 3]


def test_config(tmp_path):
    path = tmp_path / "c" / "config.toml"
    assert config.load(path) == config.EngineConfig()
    assert config.create_default_if_missing(path) and not config.create_default_if_missing(path)
    assert config.load(path) == config.EngineConfig()
    path.write_text("[search]\nmin_similarity = 0.4\nunknown = 1\n")
    assert config.load(path).min_similarity == 0.4
    path.write_text("not [ toml")
    assert config.load(path) == config.EngineConfig()


def call(server, **request):
    out = server.respond(json.dumps({"jsonrpc": "2.0", **request}))
    return json.loads(out) if out else None


def test_server(engine, tmp_path):
    server = Server(engine.tools)
    assert call(server, id=1, method="initialize", params={"protocolVersion": "x"})["result"]["protocolVersion"] == "x"
    assert call(server, id=1, method="initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert [t["name"] for t in call(server, id=2, method="tools/list")["result"]["tools"]] == ["save_thread", "load_thread", "search_memory"]
    assert call(server, id=3, method="resources/list")["result"] == {"resources": []} and call(server, id=3, method="resources/templates/list")["result"] == {"resourceTemplates": []}
    assert call(server, id=4, method="ping")["result"] == {} and call(server, method="notifications/initialized") is None and call(server, method="unknown") is None
    assert call(server, id=5, method="unknown")["error"]["code"] == -32601
    assert call(server, id=6, method="tools/call")["error"]["code"] == -32602 and call(server, id=6, method="tools/call", params={"name": "x"})["error"]["code"] == -32602
    assert call(server, method="tools/call")["error"]["code"] == -32602  # errors are sent for notifications too
    failed = call(server, id=7, method="tools/call", params={"name": "search_memory", "arguments": {}})["result"]
    assert failed["isError"] and "'query' has to be" in failed["content"][0]["text"]
    done = call(server, id=8, method="tools/call", params={"name": "load_thread", "arguments": {"project_path": "/no"}})["result"]
    assert json.loads(done["content"][0]["text"]) == {"success": False, "project_path": "/no"} and "isError" not in done
    assert json.loads(server.respond("{"))["error"]["code"] == -32700 and server.respond("  ") is None
    out = io.StringIO()
    server.run(['{"id": 1, "method": "ping"}\n', "\n", '{"method": "initialized"}\n'], out)
    assert out.getvalue().count("\n") == 1

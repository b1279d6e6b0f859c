"""Projects: registry upkeep, listing, overview, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text
from factloom.operators.windows import newest


def upserted(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Registry (project_id, name, last_known_path, last_seen) after `seen` rows of the same columns: the latest per project wins.

    A project that was seen at another path moves; one that is new is added; the rest stays.
    """
    latest = seen.groupBy("project_id").agg(F.max_by(F.struct("name", "last_known_path", "last_seen"), F.struct("last_seen", "last_known_path")).alias("_new"))
    both = registry.join(latest, "project_id", "full_outer")
    return both.select("project_id", *(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in ("name", "last_known_path", "last_seen")))


def with_status(registry: DataFrame, live: DataFrame) -> DataFrame:
    """Adds `status`: valid where the path is among `live` (path)."""
    own = live.select(F.col("path").alias("_path")).distinct()
    return registry.join(own, registry.last_known_path == own._path, "left").withColumn("status", F.when(F.col("_path").isNotNull(), schemas.VALID).otherwise(schemas.INVALID)).drop("_path")


def listing(registry: DataFrame, live: DataFrame, threads: DataFrame, now: Column) -> DataFrame:
    """All projects: the registry's, and stored threads whose path it doesn't list.

    Threads are (project_path, facts_count, created_at, updated_at, has_architecture).  An invalid project has no facts and the times it was last seen; a
    valid one without a thread has none and the present time.  Newest first is the caller's sort, by updated_at.
    """
    own = with_status(registry, live).join(threads, F.col("last_known_path") == threads.project_path, "left")
    bad, stored = F.col("status") == schemas.INVALID, F.col("project_path").isNotNull()
    otherwise = F.when(bad, F.col("last_seen")).otherwise(now)

    def take(name: str, default: Column) -> Column:
        return F.when(~bad & stored, F.col(name)).otherwise(default).alias(name)

    listed = own.select(F.col("last_known_path").alias("path"), "name", "status", take("facts_count", F.lit(0).cast("long")), take("created_at", otherwise), take("updated_at", otherwise), take("has_architecture", F.lit(False)))
    rest = threads.dropDuplicates(["project_path"]).join(registry, threads.project_path == registry.last_known_path, "left_anti").join(live.select(F.col("path").alias("_path")).distinct(), threads.project_path == F.col("_path"), "left")
    status = F.when(F.col("_path").isNotNull(), schemas.VALID).otherwise(schemas.INVALID)
    return listed.unionByName(rest.select(F.col("project_path").alias("path"), text.basename(F.col("project_path")).alias("name"), status.alias("status"), "facts_count", "created_at", "updated_at", "has_architecture"))


def by_status(listed: DataFrame) -> DataFrame:
    """(status, path) rows; an array a status is made only by who answers with one."""
    return listed.select("status", "path")


def preferred(local: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Local rows, and shared ones whose key no local row has."""
    return local.unionByName(shared.join(local, key, "left_anti"))


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    """The last sessions of each project, newest first."""
    return newest(sessions, ["project_id"], [F.desc("ord")], n)


def recent_decisions(facts: DataFrame, n: int = 10) -> DataFrame:
    """The last decisions of each project, newest first."""
    return newest(facts.where(F.col("category") == schemas.DECISION), ["project_id"], [F.desc("ord")], n)


def overview(projects: DataFrame, facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row a project: its own columns, recent sessions and decisions, and totals."""

    def listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("recency", value.alias("value")))), lambda x: x["value"])
        return rows.groupBy("project_id").agg(items.alias(name))

    totals = facts.groupBy("project_id").agg(F.count("*").alias("total_facts"))
    counts = sessions.groupBy("project_id").agg(F.count("*").alias("total_sessions"))
    recent = listed(recent_sessions(sessions), F.struct("summary", "facts_count", "created_at"), "recent_sessions")
    decided = listed(recent_decisions(facts), F.col("content"), "recent_decisions")
    out = projects
    for part in (recent, decided, totals, counts):
        out = out.join(part, "project_id", "left")
    none = {"recent_sessions": F.expr("cast(array() as array<struct<summary:string,facts_count:bigint,created_at:timestamp>>)"), "recent_decisions": F.expr("cast(array() as array<string>)"), "total_facts": F.lit(0).cast("long"), "total_sessions": F.lit(0).cast("long")}
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in none.items()})


def with_usage(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Adds access_count and last_used_at, from the append-only log (project_id, fact_id, used_at)."""
    used = log.groupBy("project_id", "fact_id").agg(F.count("*").alias("access_count"), F.max("used_at").alias("last_used_at"))
    return facts.join(used, ["project_id", "fact_id"], "left").withColumn("access_count", F.coalesce("access_count", F.lit(0).cast("long")))

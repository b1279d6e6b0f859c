"""Schemas of the stored documents and of the normalised tables."""

from __future__ import annotations

BELIEF = "struct<alpha:float,beta:float,decay_rate:float>"
FACT = f"struct<id:string,content:string,category:string,confidence:float,created_at:timestamp,updated_at:timestamp,embedding:array<float>,utility:{BELIEF},access_count:bigint,last_used_at:timestamp,context_window:array<string>,session_id:string>"
SESSION = "struct<id:string,summary:string,fact_ids:array<string>,created_at:timestamp>"
STATE = "struct<completed:array<string>,in_progress:array<string>,pending:array<string>>"
#: One document per project.
THREAD = f"project_path string, project_hash string, created_at timestamp, updated_at timestamp, architecture string, state {STATE}, facts array<{FACT}>, sessions array<{SESSION}>, metadata map<string,variant>"
META = "project_id string, project_name string, created_at timestamp"
REGISTRY = "version int, projects map<string,struct<name:string,last_known_path:string,last_seen:timestamp>>"
SEARCH_LOG = "search_id string, project_id string, ts timestamp, query_embedding array<float>, returned_fact_ids array<string>"

ARCHITECTURE, DECISION, GENERAL = "architecture", "decision", "general"
CATEGORIES = (ARCHITECTURE, DECISION, GENERAL)
VALID, INVALID = "valid", "invalid"

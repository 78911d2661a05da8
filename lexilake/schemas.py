"""Schemas of the logical tables."""

from __future__ import annotations

PLACEHOLDERS = "map<string,struct<example:string,type:string>>"
PLACEHOLDER_LIST = "array<struct<name:string,type:string>>"

SOURCE_KEYS = (
    f"project int, locale string, key string, text string, description string, "
    f"placeholders {PLACEHOLDERS}, source_hash string"
)
ENTRIES = (
    "project int, locale string, key string, text string, reviewed boolean, stale boolean, "
    "source_hash string, provider string, model_version string, translated_at timestamp_ntz"
)
CACHE = (
    "project int, source_hash string, locale string, config_hash string, model_version string, "
    "text string, cached_at timestamp_ntz"
)
CACHE_KEY = ["project", "source_hash", "locale", "config_hash", "model_version"]
HISTORY = (
    "id string, op string, actor string, ts string, summary string, `from` string, before string, "
    "after string, key string, locale string, `to` string, files_updated int, "
    "renames array<struct<before:string,after:string>>"
)
SYNC_STATE = (
    "project int, completed_translations int, total_translations int, status string, current_key string, "
    "current_locale string, last_processed_key string, last_processed_locale string, config_hash string, "
    "source_hash string, started_at timestamp_ntz, updated_at timestamp_ntz"
)
RULES = "project int, key_case string, max_depth int, scopes array<string>, forbidden_prefixes array<string>"
GLOSSARY = "project int, source_term string, locale string, target_term string"
PLATFORM_ENTRIES = (
    f"project int, platform string, locale string, key string, text string, comment string, "
    f"placeholders {PLACEHOLDER_LIST}"
)
RENAME_PLAN = "project int, from_key string, to_key string, rationale string, skip_reason string"
SNAPSHOTS = "history_id string, path string, content string"
DIAGNOSTICS = (
    "project int, code string, level string, locale string, key string, path string, "
    "details map<string,string>"
)

ENTRY_COLUMNS = ["project", "locale", "key", "text", "reviewed", "stale", "source_hash", "provider",
                 "model_version", "translated_at"]

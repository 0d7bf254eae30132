"""Table schemas of a vault. Nothing is inferred; JSON columns of exports become arrays on reading."""

from __future__ import annotations

TABLES = {
    "documents": "id long, collection string, path string, title string, hash string, body_length int, created_at timestamp_ntz, modified_at timestamp_ntz, authored_at timestamp_ntz, active boolean, domain string, workstream string, tags array<string>, content_type string, review_by timestamp_ntz, confidence double, access_count long, quality_score double, pinned boolean, snoozed_until timestamp_ntz, last_accessed_at timestamp_ntz, archived_at timestamp_ntz, memory_type string, normalized_hash string, duplicate_count long, last_seen_at timestamp_ntz, topic_key string, revision_count long, deactivated_reason string, origin string, observation_type string, facts array<string>, narrative string, source_doc_ids array<long>, invalidated_at timestamp_ntz, invalidated_by long, superseded_by long",
    "content": "hash string, doc string, created_at timestamp_ntz",
    "vectors": "id long, doc_id long, seq int, pos int, model string, fragment_type string, fragment_label string, embedding array<float>",
    "relations": "source_id long, target_id long, relation_type string, weight double, metadata string, created_at timestamp_ntz",
    "entities": "id string, name string, entity_type string, created_at timestamp_ntz",
    "mentions": "doc_id long, entity_id string, mention string",
    "triples": "id long, subject string, predicate string, object string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, created_at timestamp_ntz",
    "provenance": "triple_id long, doc_id long, fact string, created_at timestamp_ntz",
    "recall_events": "event_id long, doc_id long, query_hash string, search_score double, session_id string, usage_id long, turn_index int, surfaced_at timestamp_ntz, was_referenced boolean, dedupe_key string",
    "usage": "id long, session_id string, used_at timestamp_ntz, hook_name string, injected_paths array<string>, estimated_tokens long, was_referenced boolean, turn_index int, query_text string, dedupe_key string",
    "sessions": "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, handoff_path string, machine string, files_changed array<string>, summary string",
    "observations": "id long, observation string, proof_count long, source_doc_ids array<long>, trend string, status string, collection string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "evolution": "memory_id long, triggered_by long, version int, previous_keywords array<string>, new_keywords array<string>, created_at timestamp_ntz",
    "issues": "issue_id string, title string, status string, priority int, description string, created_at timestamp_ntz",
    "issue_links": "source string, target string, kind string",
}

"""The record model: explicit schemas (as DDL) of envelopes, traces, errors, snapshots and intents."""

ENVELOPE = (
    "entity_key string, event_time_ms bigint, arrival bigint, kind string, external_event string, "
    "tool_result struct<intent_id: string, status: string, payload: string>, "
    "approval struct<intent_id: string, approved: boolean, approver: string, decided_at_ms: bigint>, "
    "export_request struct<request_id: string>"
)
TRACE_EVENT = (
    "trace_id string, span_id string, parent_span_id string, entity_key string, seq bigint, step_index bigint, "
    "event_type string, start_ms bigint, end_ms bigint, attributes map<string, string>, provenance string, arrival bigint"
)
ERROR_RECORD = ("error_id string, entity_key string, seq bigint, reason string, detail string, event_time_ms bigint, provenance string, arrival bigint")
SNAPSHOT = (
    "entity_key string, seq bigint, snapshot_at_ms bigint, state_schema_version int, request_id string, memory_entries bigint, "
    "memory_bytes bigint, llm_cache_entries bigint, pending_intent_ids array<string>, continuation_step_index bigint, "
    "continuation_deadline_ms bigint, continuation_adapter string, raw binary, provenance string, arrival bigint"
)
INTENT = ("entity_key string, seq bigint, ordinal bigint, intent_id string, tool_name string, kind string, args_json string, step_index bigint, created_at_ms bigint, expires_at_ms bigint")
OUTCOME = ("entity_key string, seq bigint, scenario string, label string, event_time_ms bigint")

#: The closed vocabularies of the record model.
EVENT_TYPES = ["ACTIVATION_START", "LLM_CALL", "TOOL_CALL", "INTENT_EMITTED", "SUSPENDED", "ACTIVATION_END", "ERROR"]
REASONS = [
    "activation_timeout", "activation_error", "orphaned_result", "ttl_wiped_suspension", "ttl_wiped_batch",
    "batch_buffer_overflow", "budget_exceeded", "intent_dead_letter", "hitl_timeout", "malformed_input_row",
]
STATUSES = ["completed", "suspended", "error", "in_flight"]
KINDS = ["start", "resume", "unknown"]
PROVENANCES = ["native", "otlp", "kafka", "bigquery", "bundle"]

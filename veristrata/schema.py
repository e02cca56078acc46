"""Column schemas of the ledger and index tables, and the caps that are part of the queries' meaning."""

from __future__ import annotations

FILES = "path string, hash string, language string, size_bytes bigint, indexed_at bigint"
SYMBOLS = "id bigint, file_path string, name string, qualified_name string, kind string, signature string, start_line int, end_line int, exported boolean, parent_id bigint"
TRUTH_CHANGE = "struct<scope:string,files:array<string>,diff_ref:string,motivated_by:string,supersedes:bigint,trivial:boolean,trivial_reason:string>"
DECISIONS = f"id bigint, topic string, choice string, reasoning string, recorded_at bigint, superseded_by bigint, related_files array<string>, related_symbols array<string>, truth_change {TRUTH_CHANGE}"
CLAIMS = "id bigint, session_id string, claim string, evidence string, verified boolean, recorded_at bigint, file_path string, superseded_by bigint, tool string, index_ok boolean, vet_ok boolean, vet_error_summary string, last_checked bigint, ttl bigint"

#: Rows a store query returns at most, and what tools return by default and at most (fixed values).
STORE_ROWS = 1000
SYMBOL_ROWS = 500
SUGGESTIONS = 5
LIST_FILES = (200, 1000)
RECENT = (50, 500)
DECISION_ROWS = (20, 200)
STALE_ROWS = (50, 200)
UNVERIFIED_ROWS = (50, 200)
HISTORY_ROWS = 200
RESPONSE_BYTES = 1 << 20
INDEXED_BYTES = 2 << 20
READ_BYTES = 1 << 20
NOTE_BYTES = 4 << 10
QUERY_BYTES = 4 << 10
LINE_BYTES = 1 << 20
PAYLOAD_BYTES = 4 << 20
RPC_BYTES = 16 << 20
CLAIM_TEXT_BYTES = 1 << 20
EVIDENCE_BYTES = 16 << 10
SUMMARY_BYTES = 200


def clamp(limit: int | None, bounds: tuple[int, int]) -> int:
    """A tool's limit: the default for none or 0, else at most the maximum; negative counts as none."""
    default, most = bounds
    return default if not limit or limit < 0 else min(limit, most)

"""Row types of payloads, contracts and extracted documents."""

from __future__ import annotations

PLACE = "external_id string, name string, legal_name string, city string, address string, phone string, website string, working_hours string, latitude double, longitude double"
SNAPSHOT = "source_url string, requested_url string, final_url string, http_status int, response_headers map<string,string>, content_type string, checksum string, content_sha256 string, byte_size long, storage_uri string, source_document_date string, captured_at timestamp"
SERVICE = "external_id string, name string, category string, description string, price string, currency string, updated_at string, source_url string, parsed_at timestamp, raw_source_row_id long, raw_item string, duration_minutes int, is_available boolean"
PAYLOAD = f"source string, source_type string, source_url string, robots_policy_notes string, crawl_delay_seconds int, source_batch_id string, parser_run_id long, raw_snapshot struct<{SNAPSHOT}>, clinic struct<{PLACE}>, branch struct<{PLACE}>, services array<struct<{SERVICE}>>"
CONTRACT_ROW = "row_id string, source_url string, parsed_at timestamp, branch_external_id string, service_name_raw string, service_category_raw string, price_raw string, price string, currency string, updated_at string, is_available boolean, duration_minutes int, duration_days int, raw string"
CONTRACT = f"contract_version string, source struct<id string, name string, type string, source_url string, parsed_at timestamp>, clinic struct<{PLACE}>, branches array<struct<{PLACE}>>, rows array<struct<{CONTRACT_ROW}>>"
CANONICAL = "canonical_key string, name_ru string, name_kk string, name_en string, category_ru string, category_kk string, category_en string, aliases array<string>"
PROFILE = "profile_id string, profile_version string, source_id string, approved_hosts array<string>, approved_paths array<string>, columns struct<service_name int, price int, code int, unit int, category int, section int, duration int>, table_selection struct<index int, min_rows int>, validation struct<min_rows int, max_rows int, min_price double, max_price double, required_columns array<int>>"
CELL = "table_index int, row_index int, col_index int, text string, colspan int, rowspan int, is_header boolean, row_is_header boolean, page_or_sheet string, heading string"
BLOCK = "block_index int, block_type string, text string, page_or_sheet string"
ITEM = "item_index int, code string, name string, price_raw string, fee_raw string"
EXTRACTED = f"doc_id string, format string, error string, truncated boolean, cells array<struct<{CELL}>>, blocks array<struct<{BLOCK}>>, items array<struct<{ITEM}>>"

"""Table schemas as Spark DDL."""

RECEIPTS = """
    receipt_id STRING, total DOUBLE, purchased_at TIMESTAMP, store_name STRING, store_entity_id STRING,
    receipt_category STRING, receipt_category_source STRING,
    receipt_subcategories ARRAY<STRUCT<subcategory:STRING,total:DOUBLE>>,
    line_items_raw ARRAY<STRUCT<raw_name:STRING,line_total:DOUBLE,qty_raw:STRING,unit_price_raw:DOUBLE>>,
    merchant_hints STRUCT<org_number:STRING,phone:STRING,store_id:STRING,address:STRING,postal_code:STRING,city:STRING,branch_name:STRING>,
    currency STRING, raw_text STRING, ocr_text STRING, ocr_confidence INT, content_hash STRING,
    extract_status STRING, extract_attempts INT, extract_queued_at TIMESTAMP, extract_started_at TIMESTAMP,
    extract_finished_at TIMESTAMP, extract_duration_ms BIGINT, extract_queue_delay_ms BIGINT,
    extract_method STRING, extract_provider STRING, extract_model STRING,
    source_type STRING, source_meta MAP<STRING,STRING>, file_path STRING, filename STRING, created_at TIMESTAMP
"""
LINE_ITEMS = """
    line_item_id STRING, receipt_id STRING, raw_name STRING, line_total DOUBLE, qty_raw STRING,
    unit_price_raw DOUBLE, matched_product_id STRING, match_confidence INT
"""
OBSERVATIONS = """
    observation_id STRING, product_id STRING, store_name STRING, observed_at TIMESTAMP, pack_price DOUBLE,
    unit_price DOUBLE, unit_type STRING, confidence INT, receipt_id STRING, line_item_id STRING
"""
PRODUCTS = """
    product_id STRING, canonical_name STRING, aliases ARRAY<STRING>, unit_type STRING,
    created_at TIMESTAMP, updated_at TIMESTAMP
"""
STORES = """
    store_entity_id STRING, chain_name STRING, branch_name STRING, address STRING, postal_code STRING, city STRING,
    org_number STRING, phone STRING, store_id STRING, aliases ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP
"""
PRODUCT_STATE = """
    product_id STRING, last_auto_added_at TIMESTAMP, last_store_tag STRING, last_store_tag_confidence DOUBLE,
    last_seen_at TIMESTAMP, last_seen_confidence DOUBLE
"""
STORE_ALIASES = "key STRING, canonical STRING"
PROCESSED_FILES = "fingerprint STRING, content_hash STRING, path STRING, filename STRING, size BIGINT, mtime BIGINT, processed_at TIMESTAMP"
INVENTORY_IMAGES = """
    image_id STRING, file_path STRING, filename STRING, fingerprint STRING, taken_at TIMESTAMP, status STRING,
    attempts INT, created_at TIMESTAMP, updated_at TIMESTAMP, raw_result STRING
"""
ACTIVITIES = "activity_id STRING, timestamp TIMESTAMP, kind STRING, description STRING, payload STRING"
SHOPPING_LIST = "id STRING, name STRING, complete BOOLEAN"
UPLOADS = "chat_id BIGINT, filename STRING, caption STRING, content BINARY"

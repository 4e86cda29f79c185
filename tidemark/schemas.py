"""Schemas of the core records as DDL strings."""

ASSETS = """asset_id STRING, symbol STRING, exchange STRING, currency STRING, name STRING, sector STRING, industry STRING, active_from DATE, active_to DATE,
cik STRING, figi STRING, isin STRING, short_available BOOLEAN, hard_to_borrow BOOLEAN, trading_unit BIGINT"""
BARS = """asset_id STRING, symbol STRING, ts TIMESTAMP, bar_size STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, vwap DOUBLE,
adjusted_close DOUBLE, corporate_action_adjusted BOOLEAN, adjustment_vintage_at TIMESTAMP, return_adjustment_factor DOUBLE, exchange STRING, currency STRING,
trading_unit BIGINT, session_date DATE, available_at TIMESTAMP, price_basis STRING"""
ENTITIES = "ARRAY<STRUCT<asset_id: STRING, symbol: STRING, name: STRING, relevance: DOUBLE, mention_type: STRING, confidence: DOUBLE>>"
TEXT_ITEMS = f"""item_id STRING, source STRING, source_type STRING, language STRING, title STRING, body STRING, published_at TIMESTAMP, vendor_received_at TIMESTAMP,
ingested_at TIMESTAMP, available_at TIMESTAMP, event_ts TIMESTAMP, processed_at TIMESTAMP, event_type STRING, relationship_type STRING, content_status STRING,
retention_permitted BOOLEAN, license_or_terms_ref STRING, raw_text_hash STRING, canonical_text_hash STRING, author_hash STRING, url_hash STRING,
parent_item_id_hash STRING, raw_text_path STRING, entities {ENTITIES}"""
FUNDAMENTALS = "asset_id STRING, symbol STRING, period_end DATE, available_at TIMESTAMP, values MAP<STRING, STRING>, filing_id STRING"
EARNINGS = "asset_id STRING, symbol STRING, event_ts TIMESTAMP, available_at TIMESTAMP, status STRING"
ACTIONS = "asset_id STRING, symbol STRING, event_ts TIMESTAMP, available_at TIMESTAMP, action_type STRING, value DOUBLE"

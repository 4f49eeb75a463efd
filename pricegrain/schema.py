"""Row types of the tables that the library reads and writes."""

from __future__ import annotations

RAW_OFFER = (
    "url string, name string, price double, price_raw string, currency string, external_id string, image_url string, description string, category string, "
    "stock_status string, stock_raw string, sku string, mpn string, upc string, ean string, gtin string, brand string, extra map<string,string>"
)
OFFER = (
    "id long, store_id long, external_id string, url string, name string, normalized_name string, name_key string, tokens array<string>, price double, "
    "stock_status string, game string, set_code string, product_type string, quantity int, quantity_confidence double, units_total int, language string, "
    "product_id long, match_score double, match_method string, content_hash string, first_seen_at timestamp, last_seen_at timestamp, last_changed_at timestamp, "
    "last_price_change_at timestamp, is_active boolean"
)
PRICE_HISTORY = "store_product_id long, price double, currency string, recorded_at timestamp"
STOCK_HISTORY = "store_product_id long, stock_status string, recorded_at timestamp"
EVENT = "type string, store_id long, store_product_id long, product_id long, old_value string, new_value string, pct_change double, message string, created_at timestamp"
MANUAL_MATCH = "a_key string, b_key string, decision string"
MANUAL_ATTRIBUTE = "entity_key string, attribute string, value string"
ALERT = "product_id long, target_price double, only_in_stock boolean, active boolean, last_triggered_price double"
WATCH = "url string, price double, stock_status string, http_status int"
#: What a resolution needs of an offer.
CANDIDATE = (
    "id long, stable_key string, game string, set_code string, product_type string, language string, units_total int, quantity_confidence double, "
    "name_key string, name string, tokens array<string>, gtins array<string>, mpns array<string>, sku string"
)

"""Table schemas. JSON is decoded into typed columns once, at load; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

HOURS = "array<string>"
FEATURES = "array<string>"
FEATURE_GROUPS = "map<string,struct<count:string,items:array<string>>>"
MENU = "map<string,array<struct<name:string,price:string,portion:string>>>"
SOCIAL_LINKS = "map<string,array<string>>"
IMAGES = "array<struct<preview:string,preview_size:string,original:string>>"

JSON_COLUMNS = {
    "working_hours": HOURS,
    "features": FEATURES,
    "feature_groups": FEATURE_GROUPS,
    "menu": MENU,
    "social_links": SOCIAL_LINKS,
    "images": IMAGES,
}

TABLES = {
    "cities": (
        "id bigint, name string, slug string, region string, url string, weight int, total_establishments int, "
        "created_at timestamp"
    ),
    "categories": (
        "id bigint, name string, slug string, parent_id bigint, url string, created_at timestamp, "
        "updated_at timestamp"
    ),
    "companies": (
        "id bigint, external_id string, name string, description string, address string, city_id bigint, "
        "phone string, email string, website string, rating decimal(2,1), review_count int, url string, "
        "latitude decimal(10,8), longitude decimal(11,8), working_hours string, metro_station string, "
        "metro_distance string, business_lunch boolean, delivery boolean, takeaway boolean, wifi boolean, "
        "parking boolean, payment_cards boolean, features string, feature_groups string, menu string, "
        "social_links string, images string, raw_data string, source string, source_url string, "
        "source_category string, is_normalized boolean, created_at timestamp, updated_at timestamp, "
        "parsed_at timestamp"
    ),
    "company_categories": "company_id bigint, category_id bigint",
    "reviews": (
        "id bigint, company_id bigint, author_name string, rating int, text string, date date, source string, "
        "created_at timestamp"
    ),
    "company_phones": "company_id bigint, phone string",
    "tags": "id bigint, name string, slug string, category string",
    "company_tags": "company_id bigint, tag_id bigint",
    "favorites": "user_id bigint, company_id bigint",
    "parse_logs": (
        "id bigint, task_type string, status string, message string, items int, started_at timestamp, "
        "completed_at timestamp"
    ),
    "progress": (
        "city_id bigint, categories_parsed array<string>, total bigint, last_attempt timestamp, status string"
    ),
}

FLAGS = ("business_lunch", "delivery", "takeaway", "wifi", "parking", "payment_cards", "is_normalized")


def struct_type(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])

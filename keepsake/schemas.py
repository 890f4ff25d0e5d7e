"""Schemas of the model tables.

Ids come from the data (natural keys or hashes). Times are seconds (DOUBLE) inside a
media item and TIMESTAMP elsewhere. Free-form attributes are JSON text and parsed into
``MAP<STRING, STRING>`` when used.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

_DDL = {
    "items": "id LONG, domain STRING, type STRING, title STRING, attrs_json STRING, "
             "attrs_ai STRING, content_text STRING, media_paths STRING, source_type STRING, "
             "source_ref STRING, category_id LONG, category_conf DOUBLE, auto_note STRING, "
             "status STRING, created_at TIMESTAMP",
    "chunks": "id LONG, item_id LONG, modality STRING, content STRING, media_path STRING, "
              "start_ts DOUBLE, end_ts DOUBLE, seq INT, embed_status STRING",
    "vectors": "chunk_id LONG, embedding ARRAY<FLOAT>, item_id LONG, domain STRING, "
               "type STRING, category_id LONG, source_type STRING, start_ts DOUBLE",
    "categories": "id LONG, domain STRING, parent_id LONG, name STRING, sort INT, status STRING",
    "profile": "id LONG, domain STRING, key STRING, value_json STRING, source STRING, "
               "updated_at TIMESTAMP",
    "logs": "id LONG, domain STRING, happened_at TIMESTAMP, content_text STRING, "
            "attrs_json STRING, related_item_ids STRING, source STRING",
    "jobs": "id LONG, type STRING, payload STRING, status STRING, dedup_key STRING, "
            "priority INT, error STRING, created_at TIMESTAMP, started_at TIMESTAMP, "
            "finished_at TIMESTAMP",
    "prompts": "id LONG, name STRING, stage STRING, category_id LONG, version INT, "
               "content STRING, status STRING, origin STRING, created_at TIMESTAMP",
    "prompt_feedback": "id LONG, prompt_id LONG, item_id LONG, critique STRING, "
                       "dimension STRING, action_taken STRING, created_at TIMESTAMP",
    "watch_sources": "id LONG, kind STRING, target STRING, domain STRING, enabled INT, "
                     "label STRING, last_checked TIMESTAMP, created_at TIMESTAMP",
    "links": "item_a LONG, item_b LONG, score DOUBLE, created_at TIMESTAMP",
    "owner_rules": "owner_id STRING, owner_name STRING, category_id LONG, created_at TIMESTAMP",
    "bindings": "id LONG, kind STRING, target STRING, stage STRING, prompt_name STRING, "
                "priority INT, enabled INT, note STRING, payload STRING, created_at TIMESTAMP",
    "clips": "id LONG, item_id LONG, start_ts DOUBLE, end_ts DOUBLE, kind STRING, "
             "reason STRING, confidence DOUBLE, created_at TIMESTAMP",
    "capture": "type STRING, url STRING, title STRING, text STRING, domain STRING, "
               "product STRUCT<name: STRING, price: STRING, image_url: STRING, shop: STRING>, "
               "video STRUCT<platform: STRING, id: STRING, t: DOUBLE>",
    "verdict": "item_id LONG, category_id LONG, new_name STRING, confidence DOUBLE, reason STRING",
}


def ddl(name: str) -> str:
    return _DDL[name]


def schema(name: str) -> StructType:
    """StructType of a model table. Needs an active Spark session to parse the text form."""
    return _parse_datatype_string(_DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring older data to the current table shape: missing columns become null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema(name).fields])

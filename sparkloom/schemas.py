"""Declared schemas of the stage tables, checked on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The columns of each stage table.
DDL = {
    "items": (
        "main_category string, parent_asin string, title string, description string, features string, price double, average_rating double, "
        "rating_number bigint, store string, categories array<string>, sub_category string, image_url string"
    ),
    "interactions": "parent_asin string, user_id string, rating double, timestamp_ms bigint, helpful_vote bigint, verified_purchase boolean",
    "embeddings": "item_id bigint, embedding array<float>",
    "item2feat": "item_id bigint, sid_0 bigint, sid_1 bigint, sid_2 bigint, sid_3 bigint",
    "cpt_corpus": "seq_type string, input_text string, target_text string",
    "raw_review": "parent_asin string, user_id string, rating double, timestamp bigint, helpful_vote bigint, verified_purchase boolean",
    "raw_item": (
        "main_category string, parent_asin string, title string, description array<string>, features array<string>, price string, average_rating double, "
        "rating_number bigint, store string, categories array<string>, images array<struct<large: string, thumb: string>>"
    ),
}
DDL["catalog"] = DDL["items"] + ", item_id bigint, image_local_path string, has_image boolean, split string"


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])


def check(df: DataFrame, name: str) -> DataFrame:
    """df, or ValueError that names the columns it lacks or has in another type."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema(name) if f.name not in have or have[f.name].simpleString() != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{name}: missing or of another type: {', '.join(wrong)}")
    return df

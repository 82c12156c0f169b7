"""Prototypes of calls from JSON: header -> [{name, type, desc, default?}]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_prototypes(texts: DataFrame, column: str = "value") -> DataFrame:
    """(header, ordinal, pos, name, type, has_default, default); a default that is null still makes one optional."""
    parsed = F.from_json(F.col(column), "map<string,array<map<string,string>>>")
    headers = texts.select(F.posexplode(F.map_entries(parsed)).alias("ordinal", "e"))
    params = headers.select(F.col("e.key").alias("header"), "ordinal", F.posexplode("e.value").alias("pos", "p"))
    get = lambda k: F.try_element_at("p", F.lit(k))
    return params.select("header", "ordinal", "pos", get("name").alias("name"), get("type").alias("type"), F.map_contains_key("p", "default").alias("has_default"), get("default").alias("default"))

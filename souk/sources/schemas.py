"""Declared schemas of the marketplace tables (S5) and read-time casts.

Money stays ``DecimalType``; JSON columns stay text and are parsed where a
rule needs them (``from_json`` gives null on bad input; the text is kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DecimalType, IntegerType, StringType,
                               StructField, StructType, TimestampType)

S, B, I, TS = StringType(), BooleanType(), IntegerType(), TimestampType()


def _st(*fields) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, StructType] = {
    "users": _st(("id", S, False), ("name", S, False), ("email", S, False), ("password_hash", S, True),
                 ("role", S, False), ("avatar", S, True), ("bio", S, True), ("is_active", B, False),
                 ("created_at", TS, False), ("updated_at", TS, False)),
    "categories": _st(("id", I, False), ("name", S, False), ("slug", S, False), ("description", S, True),
                      ("icon", S, True), ("sort_order", I, False)),
    "services": _st(("id", S, False), ("executor_id", S, False), ("category_id", I, False), ("title", S, False),
                    ("description", S, False), ("price", DecimalType(12, 2), False), ("deadline", I, False),
                    ("is_active", B, False), ("tags", S, True), ("is_negotiable", B, False),
                    ("rating", DecimalType(3, 2), False), ("reviews_count", I, False),
                    ("orders_count", I, False), ("created_at", TS, False), ("updated_at", TS, True)),
    "orders": _st(("id", S, False), ("service_id", S, False), ("customer_id", S, False), ("executor_id", S, False),
                  ("status", S, False), ("total_price", DecimalType(12, 2), False), ("deadline_date", DateType(), True),
                  ("requirements", S, True), ("cancel_reason", S, True), ("created_at", TS, False),
                  ("updated_at", TS, False)),
    "status_log": _st(("id", I, True), ("order_id", S, False), ("old_status", S, True), ("new_status", S, False),
                      ("changed_by", S, True), ("note", S, True), ("created_at", TS, False)),
    "messages": _st(("id", S, False), ("order_id", S, False), ("sender_id", S, False), ("message", S, False),
                    ("is_read", B, False), ("created_at", TS, False)),
    "reviews": _st(("id", S, False), ("order_id", S, False), ("service_id", S, False), ("customer_id", S, False),
                   ("executor_id", S, False), ("rating", ByteType(), False), ("comment", S, True),
                   ("created_at", TS, False)),
    "balances": _st(("id", I, True), ("user_id", S, False), ("amount", DecimalType(12, 2), False),
                    ("updated_at", TS, True)),
    "transactions": _st(("id", S, False), ("user_id", S, True), ("order_id", S, True), ("type", S, False),
                        ("amount", DecimalType(12, 2), False), ("description", S, True), ("created_at", TS, False)),
    "notifications": _st(("id", S, False), ("user_id", S, False), ("type", S, False), ("title", S, False),
                         ("body", S, True), ("data", S, True), ("is_read", B, False), ("created_at", TS, False)),
    "profiles": _st(("user_id", S, False), ("availability", S, True), ("specialization", S, True),
                    ("hourly_rate", DecimalType(10, 2), True), ("response_time", S, True), ("languages", S, True),
                    ("skills", S, True), ("portfolio", S, True), ("socials", S, True), ("updated_at", TS, True)),
    "cleanup_log": _st(("id", S, False), ("run_at", TS, False), ("results", S, True), ("ran_by", S, True)),
}

# JSON columns and the shape a rule reads them as.
JSON_COLUMNS = {
    ("services", "tags"): "array<string>",
    ("notifications", "data"): "struct<order_id:string,rating:int>",
    ("profiles", "languages"): "array<string>",
    ("profiles", "skills"): "array<struct<name:string,level:int>>",
    ("profiles", "portfolio"): "array<struct<url:string,title:string,description:string>>",
    ("profiles", "socials"): "map<string,string>",
}
BOOLEAN_COLUMNS = {
    "users": ("is_active",), "services": ("is_active", "is_negotiable"), "messages": ("is_read",),
    "notifications": ("is_read",),
}


def cast_types(df: DataFrame, table: str, parse_json: bool = False) -> DataFrame:
    """Read-time casts of a raw table: 0/1 flags → boolean, money → decimal,
    timestamps → timestamp; with ``parse_json`` each JSON column gains a parsed
    ``<col>_parsed`` next to its text (null where the text is not valid JSON)."""
    schema = SCHEMAS[table]
    out = df
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        if f.name in BOOLEAN_COLUMNS.get(table, ()) and dict(df.dtypes)[f.name] != "boolean":
            out = out.withColumn(f.name, F.col(f.name).cast("int") == 1)
        else:
            out = out.withColumn(f.name, F.col(f.name).cast(f.dataType))
    if parse_json:
        for (t, c), shape in JSON_COLUMNS.items():
            if t == table and c in out.columns:
                out = out.withColumn(f"{c}_parsed", F.from_json(F.col(c), shape))
    return out

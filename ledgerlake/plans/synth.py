"""A deterministic change log made of the test tables, in Spark's and in DuckDB's SQL.

Both engines run one template; what they spell differently is filled in. Events become transactions of one change, orders
with their line items transactions of several. Eight stores are sources, ten are required.
"""

from __future__ import annotations

import re


SPARK = {
    "md5_60": lambda x: f"CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS BIGINT)",
    "lsn": lambda x: f"concat(hex(shiftrightunsigned({x}, 32)), '/', hex({x} & 4294967295))",
    "long": lambda x: f"CAST({x} AS BIGINT)",
}
DUCK = {
    "md5_60": lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)",
    "lsn": lambda x: f"upper(to_hex({x} >> 32)) || '/' || upper(to_hex({x} & 4294967295))",
    "long": lambda x: f"CAST({x} AS BIGINT)",
}
EPOCHS = ("epoch-2026-08-16T00", "epoch-2026-08-16T01")
BASE_MS = 1786857600000


def _template(d: dict) -> dict[str, str]:
    event_check = d["md5_60"]("concat('store-', lpad(CAST(user_id % 8 AS STRING), 3, '0'), '|tx-', CAST(event_id AS STRING), '|', CAST(floor(value * 100) AS BIGINT))")
    order_check = d["md5_60"]("concat('ord-', CAST(o_orderkey AS STRING), '|', CAST(floor(o_totalprice) AS BIGINT))")
    event_lsn, order_lsn = "(23817296 + 16 * event_id)", "(8589934592 + 16 * o_orderkey)"
    lines = "SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS rn FROM lineitem"
    event = f"""SELECT concat('store-', lpad(CAST(user_id % 8 AS STRING), 3, '0')) AS source_id, 'postgres' AS database_id, 'retail' AS dataset_id,
      concat('tx-', CAST(event_id AS STRING)) AS transaction_id, {d["long"](event_lsn)} AS lsn, {d["lsn"](event_lsn)} AS commit_lsn,
      {d["long"](f"{BASE_MS} + event_id")} AS commit_timestamp_ms, {event_check} AS envelope_checksum, '{EPOCHS[0]}' AS epoch_id, {d["long"]("event_id")} AS arrival_seq"""
    order = f"""SELECT concat('store-', lpad(CAST(o_custkey % 8 AS STRING), 3, '0')) AS source_id, 'postgres' AS database_id, 'retail' AS dataset_id,
      concat('ord-', CAST(o_orderkey AS STRING)) AS transaction_id, {d["long"](order_lsn)} AS lsn, {d["lsn"](order_lsn)} AS commit_lsn,
      {d["long"](f"{BASE_MS} + 3600000 + o_orderkey")} AS commit_timestamp_ms, {order_check} AS envelope_checksum, '{EPOCHS[1]}' AS epoch_id, {d["long"]("1000000000 + o_orderkey")} AS arrival_seq"""
    changes = f"""SELECT t.*, 1 AS total_order, 'public.events' AS relation,
        CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
        CAST(user_id AS STRING) AS record_key, CAST(user_id % 8 AS INT) AS partition_id, {d["long"]("floor(value * 100)")} AS amount, event_type AS status
      FROM ({event}, event_id, event_type, user_id, value FROM events) t
      UNION ALL
      SELECT t.*, 1 AS total_order, 'public.orders' AS relation, 'insert' AS operation, CAST(o_orderkey AS STRING) AS record_key,
        CAST(o_custkey % 8 AS INT) AS partition_id, {d["long"]("floor(o_totalprice)")} AS amount, o_orderstatus AS status
      FROM ({order}, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders) t
      UNION ALL
      SELECT t.*, rn + 1 AS total_order, 'public.lineitem' AS relation, 'insert' AS operation, concat(CAST(l_orderkey AS STRING), '-', CAST(rn AS STRING)) AS record_key,
        CAST(l_suppkey % 8 AS INT) AS partition_id, {d["long"]("floor(l_extendedprice)")} AS amount, l_returnflag AS status
      FROM (SELECT * FROM ({order}, o_orderkey FROM orders) o JOIN ({lines}) l ON l_orderkey = o_orderkey) t"""
    columns = "source_id, database_id, dataset_id, transaction_id, lsn, commit_lsn, commit_timestamp_ms, envelope_checksum, epoch_id, arrival_seq"
    plain = changes.replace("t.*", columns)
    return {
        "changes": f"SELECT *, concat(source_id, ':', commit_lsn, ':', transaction_id, ':', CAST(total_order AS STRING)) AS idempotency_key FROM ({plain}) c",
        # every transaction once, a few again unchanged, and a few again with another checksum
        "arrivals": f"""SELECT * FROM (
          SELECT {columns} FROM ({event} FROM events) t UNION ALL SELECT {columns} FROM ({order} FROM orders) t
          UNION ALL SELECT {columns.replace("arrival_seq", "arrival_seq + 2000000000 AS arrival_seq")} FROM ({event} FROM events WHERE event_id % 97 = 0) t
          UNION ALL SELECT {columns.replace("envelope_checksum", "envelope_checksum + 1 AS envelope_checksum").replace("arrival_seq", "arrival_seq + 3000000000 AS arrival_seq")} FROM ({event} FROM events WHERE event_id % 211 = 0) t
        ) a""",
    }


_SPARK, _DUCK = _template(SPARK), _template(DUCK)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_TABLE = re.compile(r"\b(FROM|JOIN) (events|orders|lineitem)\b")


def spark_sql(name: str) -> str:
    """The template with its tables in braces."""
    return _TABLE.sub(r"\1 {\2}", _SPARK[name])


def duck_sql(name: str) -> str:
    return _DUCK[name]

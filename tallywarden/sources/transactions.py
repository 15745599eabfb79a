"""One transaction layout over the different record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Canonical column -> expression, per source. A source that lacks a column has null there.
LAYOUTS = {
    "orders": {
        "txn_id": "o_orderkey",
        "entity_id": "o_custkey",
        "counterparty_id": "CAST(NULL AS BIGINT)",
        "ts": "o_orderdate",
        "amount": "o_totalprice",
        "kind": "'order'",
        "attrs": "o_orderpriority",
    },
    # lineitem joined to orders; the order key identifies the transaction but is not unique.
    "lines": {
        "txn_id": "l_orderkey",
        "entity_id": "o_custkey",
        "counterparty_id": "l_suppkey",
        "ts": "o_orderdate",
        "amount": "l_extendedprice",
        "kind": "'line'",
        "attrs": "l_returnflag",
    },
    "events": {
        "txn_id": "event_id",
        "entity_id": "user_id",
        "counterparty_id": "CAST(NULL AS BIGINT)",
        "ts": "ts",
        "amount": "value",
        "kind": "event_type",
        "attrs": "props",
    },
}


def to_transactions(df: DataFrame, source: str) -> DataFrame:
    """Project a source table to the canonical transaction columns."""
    return df.select(*(F.expr(e).alias(name) for name, e in LAYOUTS[source].items()))


def parse_props(df: DataFrame, column: str = "props", key: str = "k") -> DataFrame:
    """Add the integer found under ``key`` in a JSON text column; null if absent or not a number."""
    return df.withColumn(key, F.get_json_object(column, f"$.{key}").try_cast("int"))


def payments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Payer-to-payee edges: one row per order line, from customer to supplier."""
    return orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey).select(
        F.col("o_custkey").alias("payer"),
        F.col("l_suppkey").alias("payee"),
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_extendedprice").alias("amount"),
    )

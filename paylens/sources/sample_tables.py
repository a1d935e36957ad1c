"""The seven tables derived from a TPC-H-like star schema plus an event table.

Used by tests, the benchmark and the driver entry. A lookup (orders, part) is
joined only if a column of it is asked for; every lookup is by primary key, so
leaving it out changes no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import small
from ..operators.sizing import WIDE
from ..tables import Tables

# The moments "now" stands for: the sample events are older than the clock.
CLOCKS = {"transactions": "2001-11-05 00:00:00", "feedback": "2024-02-15 00:00:00"}

_CUSTOMER = {
    "customer_id": "c_custkey",
    "full_name": "c_name",
    "mobile_number": "concat('9', lpad(cast(c_custkey AS string), 9, '0'))",
    "age": "cast(18 + c_custkey % 60 AS int)",
    "gender": "c_mktsegment",
    "region": "r_name",
    "date_joined": "date_add(date'1995-01-01', cast((c_custkey * 17) % 2400 AS int))",
    "is_business_user": "c_mktsegment = 'MACHINERY'",
    "risk_score": "(c_acctbal + 1000.0D) / 11000.0D",
}
_MERCHANT = {
    "merchant_id": "s_suppkey",
    "merchant_name": "s_name",
    "merchant_type": "n_name",
    "region": "r_name",
    "onboard_date": "date_add(date'1995-01-01', cast((s_suppkey * 29) % 2400 AS int))",
    "risk_score": "(s_acctbal + 1000.0D) / 11000.0D",
}
_DEVICE = {
    "device_id": "p_partkey",
    "device_type": "p_type",
    "app_version": "p_brand",
    "is_rooted": "p_size > 45",
    "last_active": "cast(date_add(date'1995-06-01', cast((p_partkey * 7) % 2350 AS int))"
                   " AS timestamp_ntz)",
}
_ACCOUNT = {
    "upi_id": "o_orderkey",
    "customer_id": "o_custkey",
    "bank_name": "o_orderpriority",
    "account_type": "CASE o_orderkey % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'current'"
                    " ELSE 'wallet' END",
    "date_added": "cast(o_orderdate AS date)",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'blocked'"
              " ELSE 'suspended' END",
}
_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_WHEN = ("timestampadd(SECOND, cast((l_partkey * 37 + l_linenumber * 3607 + l_suppkey * 101)"
         " % 86400 AS int), l_shipdate)")
_TRANSACTION = {
    "transaction_id": _ID,
    "upi_id": "l_orderkey",
    "customer_id": "o_custkey",
    "timestamp": _WHEN,
    "amount": "l_extendedprice",
    "transaction_type": "CASE l_returnflag WHEN 'R' THEN 'merchant_payment' WHEN 'N' THEN"
                        " 'bill_pay' ELSE CASE l_linestatus WHEN 'F' THEN 'send'"
                        " ELSE 'receive' END END",
    "merchant_id": "CASE WHEN l_returnflag <> 'A' THEN l_suppkey END",
    "counterparty_upi": "concat('upi', l_suppkey)",
    "status": "CASE WHEN l_tax < 0.005D THEN 'failed' WHEN l_tax > 0.075D THEN 'pending'"
              " ELSE 'success' END",
    "device_id": "l_partkey",
    "device_type": "p_type",
    "channel": "concat('ch', l_linenumber)",
    "fraud_flag": "l_discount > 0.095D",
    "reversal_flag": "l_quantity >= 49D",
    "failure_reason": "CASE WHEN l_tax < 0.005D THEN"
                      " concat('reason', cast(l_quantity AS int) % 4) END",
}
_ALERT = {
    "alert_id": f"concat({_ID}, '#', k)",
    "transaction_id": _ID,
    "alert_type": "concat('type', l_linenumber)",
    "alert_date": f"timestampadd(MINUTE, 17 * k, {_WHEN})",
    "resolved": "l_partkey % 4 <> 0",
    "resolution_date": "CASE WHEN l_partkey % 4 <> 0 THEN timestampadd(MINUTE,"
                       f" cast(17 * k + (l_partkey * 53) % 4000 AS int), {_WHEN}) END",
    "remarks": "CASE WHEN l_partkey % 4 <> 0 THEN concat('closed in round ', k) END",
}
_FEEDBACK = {
    "feedback_id": "event_id",
    "customer_id": "user_id",
    "date_submitted": "cast(ts AS date)",
    "feedback_text": "props",
    "satisfaction_score": "cast(1 + event_id % 5 AS int)",
    "issue_type": "event_type",
    "resolved": "event_id % 3 <> 0",
}


_SCHEMAS: dict[str, StructType] = {}


class SampleTables(Tables):
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def columns(self, name: str) -> list[str]:
        if name == "device_info":
            return ["device_id", "customer_id", *(c for c in _DEVICE if c != "device_id")]
        return list(self._expressions(name))

    def scan(self, name: str, *columns: str) -> DataFrame:
        columns = columns or tuple(self.columns(name))
        return getattr(self, f"_{name}")(columns)

    def _expressions(self, name: str) -> dict[str, str]:
        return {
            "customer_details": _CUSTOMER, "merchant": _MERCHANT, "device_info": _DEVICE,
            "account_details": _ACCOUNT, "transaction_history": _TRANSACTION,
            "fraud_alert": _ALERT, "customer_feedback": _FEEDBACK,
        }[name]

    def _read(self, name: str) -> DataFrame:
        """The schema is read from a file footer once per path, not once per query."""
        path = f"{self._folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self._spark.read.parquet(path).schema
        return self._spark.read.schema(_SCHEMAS[path]).parquet(path)

    def _project(self, df: DataFrame, name: str, columns) -> DataFrame:
        known = self._expressions(name)
        return df.select(*[F.expr(known[c]).alias(c) for c in columns])

    def _with_place(self, df: DataFrame, nation_key: str, columns) -> DataFrame:
        if not {"region", "merchant_type"} & set(columns):
            return df
        places = self._read("nation").join(
            self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        return df.join(places, F.col(nation_key) == F.col("n_nationkey"), "left")

    def _customer_details(self, columns):
        rows = self._with_place(self._read("customer"), "c_nationkey", columns)
        return self._project(rows, "customer_details", columns)

    def _merchant(self, columns):
        rows = self._with_place(self._read("supplier"), "s_nationkey", columns)
        return self._project(rows, "merchant", columns)

    def _device_info(self, columns):
        picked = {c: F.expr(e).alias(c) for c, e in _DEVICE.items()}
        if "customer_id" in columns:
            customers = self._read("customer").agg(F.count(F.lit(1))).scalar()
            picked["customer_id"] = (F.col("p_partkey") % customers).alias("customer_id")
        return self._read("part").select(*[picked[c] for c in columns])

    def _account_details(self, columns):
        return self._project(self._read("orders"), "account_details", columns)

    def _transaction_history(self, columns):
        rows = self._read("lineitem")
        if "customer_id" in columns:
            owners = self._read("orders").select("o_orderkey", "o_custkey")
            rows = rows.join(owners, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        if "device_type" in columns:
            kinds = self._read("part").select("p_partkey", "p_type")
            rows = rows.join(small(kinds, WIDE), F.col("l_partkey") == F.col("p_partkey"), "left")
        return self._project(rows, "transaction_history", columns)

    def _fraud_alert(self, columns):
        flagged = self._read("lineitem").where("l_discount > 0.095D AND l_linenumber IN (1, 3, 5)")
        rows = flagged.withColumn(
            "k", F.explode(F.expr("IF(l_linenumber = 1, array(1, 2), array(1))"))
        )
        return self._project(rows, "fraud_alert", columns)

    def _customer_feedback(self, columns):
        return self._project(self._read("events"), "customer_feedback", columns)

"""Every report equals its literal SQL on small random tables full of trouble.

The tables hold what the sample data cannot: orphans, NULLs, repeated keys,
ties, unknown states, one-row groups, a hot customer, empty tables.
"""

import random
from datetime import date, datetime, timedelta

import duckdb
import pyarrow as pa
import pytest

from compare import difference
from oracle.statements import bodies
from paylens.model import TABLES
from paylens.plans import REPORTS
from paylens.sources.sample_tables import CLOCKS
from paylens.tables import Tables

# Reports whose SQL names the sample's column types or writes files.
LEFT_OUT = ("e0", "e10_load", "e18", "e19", "e20", "e21",
            "q16_01_vw_executive_kpis_by_batch")
NAMES = sorted(name for name in REPORTS if not name.startswith(LEFT_OUT))
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(),
          "boolean": pa.bool_(), "date": pa.date32(), "timestamp_ntz": pa.timestamp("us")}


def _tables(seed: int, customers: int, txns: int, repeat_customers: bool = False):
    r = random.Random(seed)

    def maybe(value, chance=0.1):
        return None if r.random() < chance else value

    def owner():
        return r.choice(["c0"] * 4 + [f"c{i}" for i in range(customers + 2)])

    def moment():
        return datetime(2001, 11, 6) - timedelta(seconds=r.randrange(0, 86400 * 200))

    person = [
        (f"c{i}", f"name{i % 3}", "9" * 10, r.choice([0, 24, 25, 34, 35, 54, 55, 130]),
         r.choice("mf"), r.choice(["north", "south", None]),
         date(2001, 5, 5) + timedelta(days=r.randrange(-3, 3)), maybe(r.random() < 0.5),
         r.choice([-0.1, 0.0, 0.4, 0.7, 0.25, 1.1, None]))
        for i in range(customers)
    ]
    if repeat_customers and person:
        person += person[:2]
    rows = {
        "customer_details": person,
        "merchant": [
            (f"m{i}", f"shop{i % 2}", r.choice("xy"), r.choice(["north", "south"]),
             date(2000, 1 + i % 12, 1), r.choice([0.39, 0.4, 0.7, 0.9])) for i in range(5)
        ],
        "device_info": [
            (f"d{i}", owner(), r.choice("pq"), f"v{i % 3}", r.random() < 0.5, moment())
            for i in range(customers)
        ],
        "account_details": [
            (f"u{i}", owner(), maybe(r.choice(["B1", "B2"])), r.choice("st"), date(2001, 1, 1),
             r.choice(["active", "blocked", "suspended", "odd"])) for i in range(customers * 2)
        ],
        "transaction_history": [
            (f"t{r.randrange(txns * 9 // 10 + 1)}", f"u{r.randrange(customers * 2 + 3)}",
             maybe(owner(), 0.05), moment(), maybe(r.choice([-5.0, 10.25, 10.25, 99.99, 0.05])),
             r.choice(["send", "bill_pay"]), maybe(f"m{r.randrange(6)}", 0.3), "x",
             r.choice(["success", "failed", "pending", "odd"]), f"d{r.randrange(customers + 2)}",
             r.choice("pq"), r.choice(["app", "web"]), maybe(r.random() < 0.3),
             r.random() < 0.3, maybe("why", 0.5)) for _ in range(txns)
        ],
        "customer_feedback": [
            (f"f{i}", owner(), date(2024, 1, 1) + timedelta(days=r.randrange(40)), "text",
             maybe(r.randrange(1, 7)), r.choice("ab"), r.random() < 0.5)
            for i in range(customers * 2)
        ],
        "fraud_alert": [
            (f"a{i // 2 * 2}", f"t{r.randrange(txns + 3)}", r.choice("gh"), moment(),
             r.random() < 0.5, maybe(moment(), 0.3), None) for i in range(txns // 2)
        ],
    }
    arrow = {}
    for name, table in TABLES.items():
        kinds = [_ARROW[c.type.simpleString()] for c in table.columns]
        columns = list(zip(*rows[name])) or [()] * len(kinds)
        arrow[name] = pa.table(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=table.names)
    return arrow


CASES = {
    "troubled": dict(seed=1, customers=9, txns=80, repeat_customers=True),
    "empty": dict(seed=3, customers=0, txns=0),
}


@pytest.fixture(scope="module", params=sorted(CASES))
def world(request, spark):
    arrow = _tables(**CASES[request.param])
    con = duckdb.connect()
    frames = {}
    for name, data in arrow.items():
        con.register(f"{name}_arrow", data)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
        frames[name] = spark.createDataFrame(
            data.to_pylist() and [tuple(row.values()) for row in data.to_pylist()],
            TABLES[name].schema,
        ).coalesce(2)
    return Tables(frames), con


@pytest.mark.parametrize("name", NAMES)
def test_equals_literal_sql(name, world):
    tables, con = world
    chosen = REPORTS[name]
    assert difference(chosen(tables, CLOCKS.get(chosen.clock)), con, bodies()[name]) is None

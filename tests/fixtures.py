"""Small inline flat order lines that exercise every awkward case at once.

* postal code 100 is shared by two cities in two states (region fan-out);
* ship date 02/01/2020 carries two ship modes (shipping fan-out);
* product P1 has two names (product fan-out), customer C2 two names;
* order O4 has two order dates (order fan-out);
* nulls in postal code (imputed), product id, customer id, ship date;
* an exact duplicate line, and a line equal but for its row id;
* a line shipped before it was ordered, and single-digit day-first dates.
"""

from __future__ import annotations

import pyarrow as pa

from starlane.sources.flat import FLAT_COLUMNS, FLAT_SCHEMA

#      row  order  order_date    ship_date     mode   cust  name   seg  country city  state region postal prod  cat    subcat       pname     sales
ROWS = [
    (1, "O1", "01/01/2020", "02/01/2020", "Std", "C1", "Ann", "S", "US", "A", "NY", "East", 100.0, "P1", "Tech", "Tech/Pen", "Pen", 10.25),
    (2, "O1", "01/01/2020", "03/01/2020", "Std", "C1", "Ann", "S", "US", "A", "NY", "East", 100.0, "P2", "Tech", "Tech/Ink", "Ink", 5.10),
    (3, "O2", "01/01/2020", "02/01/2020", "Exp", "C2", "Bob", "C", "US", "B", "NJ", "East", 100.0, "P1", "Tech", "Tech/Pen", "Pen v2", 7.00),
    (4, "O3", "8/1/2020", "9/1/2020", "Std", "C2", "Bobby", "C", "US", "C", "CA", "West", 200.0, "P3", "Home", "Home/Mug", "Mug", 3.33),
    (5, "O4", "10/01/2020", "15/01/2020", "Std", "C3", "Cy", "H", "US", "C", "CA", "West", 200.0, "P3", "Home", "Home/Mug", "Mug", 4.00),
    (6, "O4", "11/01/2020", "15/01/2020", "Std", "C3", "Cy", "H", "US", "C", "CA", "West", None, "P2", "Tech", "Tech/Ink", "Ink", 6.50),
    (7, "O5", "20/02/2020", "18/02/2020", "Exp", "C4", "Di", "S", "US", "D", "TX", "South", 300.0, "P4", "Office", "Office/Pad", "Pad", 2.00),
    (8, "O5", "20/02/2020", "18/02/2020", "Exp", "C4", "Di", "S", "US", "D", "TX", "South", 300.0, "P4", "Office", "Office/Pad", "Pad", 2.00),
    (8, "O5", "20/02/2020", "18/02/2020", "Exp", "C4", "Di", "S", "US", "D", "TX", "South", 300.0, "P4", "Office", "Office/Pad", "Pad", 2.00),
    (9, "O6", "05/03/2021", None, "Std", None, None, None, "US", "A", "NY", "East", 100.0, None, None, None, None, 1.50),
    (10, "O6", "05/03/2021", "07/03/2021", "Std", "C5", "Eve", "S", "US", "E", "WA", "West", None, "P5", "Home", "Home/Cup", "Cup", 8.75),
    (11, "O7", "31/12/2021", "02/01/2022", "Std", "C1", "Ann", "S", "US", "B", "NJ", "East", 100.0, "P1", "Tech", "Tech/Pen", "Pen", 12.00),
    (12, "O8", "01/01/2020", "02/01/2020", "Std", "C2", "Bob", "C", "US", "A", "NY", "East", 100.0, "P2", "Tech", "Tech/Ink", "Ink", 0.99),
]

ARROW_SCHEMA = pa.schema(
    [
        pa.field(f.name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.typeName()])
        for f in FLAT_SCHEMA.fields
    ]
)


def flat_frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, FLAT_SCHEMA)


def flat_arrow(rows=ROWS) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(FLAT_COLUMNS, r)) for r in rows], schema=ARROW_SCHEMA)

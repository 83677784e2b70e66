"""DuckDB text of the derived fixtures (FIXTURES.md §2), used as CTEs by the oracle SQL."""

FIXTURE_SQL = {
    "positions": """
WITH ord AS (
  SELECT o_custkey,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS collected,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS open_amt
  FROM orders GROUP BY o_custkey),
flow AS (
  SELECT o_custkey,
         sum(l_extendedprice * (1 - l_discount)) AS revenue,
         sum(1.6 * l_quantity * p_retailprice + l_extendedprice * l_tax) AS expenses
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey)
SELECT c_custkey AS entity_id, c_mktsegment AS segment,
       coalesce(revenue, 0) AS revenue, coalesce(expenses, 0) AS expenses,
       coalesce(open_amt, 0) * 0.5 AS liabilities, coalesce(collected, 0) AS cash
FROM customer LEFT JOIN ord ON ord.o_custkey = c_custkey LEFT JOIN flow ON flow.o_custkey = c_custkey
""",
    "series": """
SELECT l_suppkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
       sum(l_extendedprice * (1 - l_discount)) AS y
FROM lineitem
GROUP BY 1, 2
""",
    "monthly_flows": """
SELECT s_nationkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
       sum(l_extendedprice * (1 - l_discount)) AS revenue,
       sum(1.9 * l_quantity * p_retailprice + l_extendedprice * l_tax) AS expenses
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2
""",
    "supplier_flows": """
SELECT l_suppkey AS entity_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds,
       sum(l_extendedprice * (1 - l_discount)) AS revenue,
       sum(1.3 * l_quantity * p_retailprice + l_extendedprice * l_tax) AS expenses
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2
""",
    "messy": """
WITH base AS (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 50 = 0 THEN 'n/a'
         WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 23 = 0 THEN concat('(', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ')')
         WHEN o_orderkey % 37 = 0 THEN concat(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), 'e2')
         WHEN o_orderkey % 3 = 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING))
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount_text,
    CASE o_orderkey % 3
      WHEN 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10)
      WHEN 1 THEN concat(substr(CAST(o_orderdate AS STRING), 6, 2), '/', substr(CAST(o_orderdate AS STRING), 9, 2), '/', substr(CAST(o_orderdate AS STRING), 1, 4))
      ELSE substr(CAST(o_orderdate AS STRING), 1, 7) END AS date_text,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS note,
    CAST(NULL AS STRING) AS blank,
    CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice ELSE o_totalprice END AS revenue,
    CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice * 1.2 ELSE o_totalprice * 0.7 END AS expenses,
    CASE WHEN o_orderkey % 1009 = 0 THEN o_totalprice * 1e6 WHEN o_orderkey % 17 = 0 THEN o_totalprice * 2.0 ELSE o_totalprice * 0.1 END AS cash
  FROM orders)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE row_id % 20 = 0
""",
    "segment_pnl": """
SELECT s_nationkey AS entity_id, p_type AS business,
  concat('Rs ', CAST(sum(CAST(l_quantity * 900 AS DECIMAL(18,2))) AS STRING)) AS gov,
  concat('Rs ', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS STRING)) AS adj_revenue,
  CASE WHEN s_nationkey % 9 = 0 AND p_type = 'ECONOMY' THEN '-' ELSE
  concat('Rs ', CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_quantity * 1700 AS DECIMAL(18,2))) AS STRING)) END AS adj_ebitda
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
GROUP BY s_nationkey, p_type
""",
    "esg_ratings": """
SELECT s_suppkey AS entity_id, CAST(p_size AS DOUBLE) / 50 AS environmental, 1 - 5 * l_discount AS social,
       (s_acctbal + 1000) / 11000 AS governance
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
""",
    "scenarios": """
SELECT * FROM (VALUES (1,'Optimistic Growth',25,0),(2,'Moderate Growth',8,0),(3,'Pessimistic Decline',-12,0),
  (4,'Recession Impact',-25,0),(5,'Cost Cutting',0,-15),(6,'Efficiency Gains',0,-8),(7,'Inflation Pressure',0,12),
  (8,'Expansion Investment',0,30),(9,'Growth Scenario',35,20),(10,'Crisis Scenario',-35,-20),(11,'Stable Scenario',0,0))
  AS t(scenario_id, name, revenue_change, expense_change)
""",
    "questions": """
SELECT c_custkey AS q_id, c_custkey AS entity_id,
  CASE c_custkey % 5 WHEN 0 THEN 'What is my profit margin?' WHEN 1 THEN 'How long is our cash runway?'
    WHEN 2 THEN 'Is our DEBT too high?' WHEN 3 THEN 'Profit and debt outlook?' ELSE 'What should we do next?' END AS question
FROM customer
""",
    "cells": """
WITH li AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_quantity, l_returnflag,
         1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_idx
  FROM lineitem),
docs AS (SELECT DISTINCT doc_id FROM li),
cols AS (SELECT * FROM (VALUES (0,'Line'),(1,'Part'),(2,'Quantity'),(3,'Flag')) AS t(col_idx, header)),
grid AS (
  SELECT doc_id, 0 AS row_idx, col_idx, CASE WHEN col_idx = 0 THEN 'Order lines' ELSE '  ' END AS text FROM docs CROSS JOIN cols
  UNION ALL SELECT doc_id, 1, col_idx, header FROM docs CROSS JOIN cols
  UNION ALL SELECT doc_id, row_idx, col_idx,
    CASE col_idx WHEN 0 THEN CAST(l_linenumber AS STRING) WHEN 1 THEN CAST(l_partkey AS STRING)
      WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS STRING) ELSE CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END END
  FROM li CROSS JOIN cols)
SELECT doc_id, 1 + doc_id % 30 AS page, CASE WHEN doc_id % 2 = 0 THEN 'lattice' ELSE 'stream' END AS strategy,
       0 AS table_no, row_idx, col_idx, text FROM grid
UNION ALL SELECT doc_id, 0, 'lattice', 0, row_idx, col_idx, text FROM grid WHERE doc_id % 4 = 0 AND row_idx <= 1
UNION ALL SELECT doc_id, 1 + doc_id % 30, CASE WHEN doc_id % 2 = 0 THEN 'lattice' ELSE 'stream' END, 1, row_idx, col_idx,
       CASE WHEN row_idx = 1 THEN upper(text) ELSE text END FROM grid WHERE doc_id % 30 = 0
UNION ALL SELECT doc_id, 2 + doc_id % 30, 'stream', 0, row_idx, col_idx, text FROM grid WHERE doc_id % 25 = 0
UNION ALL SELECT doc_id, 1 + doc_id % 30, CASE WHEN doc_id % 2 = 0 THEN 'stream' ELSE 'lattice' END, 0, row_idx, col_idx, text
FROM grid WHERE doc_id % 35 = 0
""",
    "features": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS x1,
       CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS x2, l_discount AS x3, l_tax AS x4
FROM lineitem
""",
}

FIXTURE_SQL["customer_series"] = """
SELECT o_custkey AS entity_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS y
FROM orders GROUP BY 1, 2
"""

FIXTURE_SQL["messy_all"] = """
SELECT * FROM messy
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM messy WHERE row_id % 500 = 0
"""

# Dependencies between fixtures (a CTE must come after the ones it reads).
FIXTURE_DEPS = {"messy_all": ["messy"]}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the fixture CTEs it reads (DuckDB dialect)."""
    seen, order = set(), []

    def add(n):
        if n in seen:
            return
        for d in FIXTURE_DEPS.get(n, ()):
            add(d)
        seen.add(n)
        order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def R(expr: str, d: int) -> str:
    """The SQL twin of ``functions.exprs.rnd``: round half up on the binary value."""
    s = f"{10 ** d}.0"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"

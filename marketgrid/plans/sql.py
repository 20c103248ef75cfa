"""The supplied tables as bars, boards and ledgers in DuckDB SQL, for the oracle side of each query."""

TRADES = """trades AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
         l_quantity AS quantity, l_extendedprice AS notional, l_partkey AS part, l_returnflag AS flag,
         l_orderkey AS s1, l_linenumber AS s2, l_partkey AS s3, l_extendedprice AS s4
  FROM lineitem)"""

BARS = (
    TRADES
    + """, bars AS (
  SELECT symbol, date, first(price ORDER BY s1, s2, s3, s4) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY s1, s2, s3, s4) AS close, round(sum(quantity), 2) AS volume,
         round(sum(notional), 2) AS amount, max(CASE WHEN flag = 'N' THEN 1 ELSE 0 END) AS verified,
         count(*) AS n_lines
  FROM trades GROUP BY symbol, date)"""
)

CALENDAR = """calendar AS (
  SELECT date, row_number() OVER (ORDER BY date) AS session
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem))"""

INDUSTRY = """industry AS (
  SELECT s_suppkey AS symbol, n_name AS board FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

CONCEPTS = """concepts AS (
  SELECT DISTINCT l_suppkey AS symbol, p_brand AS board FROM lineitem JOIN part ON l_partkey = p_partkey)"""

FILLS = """fills AS (
  SELECT o_custkey AS account, o_orderkey AS fill_id, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS notional,
         CAST(floor(o_totalprice / 1000) + 1 AS BIGINT) AS shares
  FROM orders)"""

SIGNALS = """signals AS (
  SELECT event_id, user_id AS symbol, ts AS available_at, event_type,
         CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' END AS side, value
  FROM events)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"

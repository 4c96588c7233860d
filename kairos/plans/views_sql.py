"""DuckDB text of the adapter views (same rules as ``kairos.sources.adapters``).

Used only by the oracle SQL of the registered queries; the base tables are
pre-registered views in the checker.
"""

from __future__ import annotations

from kairos.functions.hashing import sql_hash
from kairos.functions.dates import HORIZON_DAYS, TEST_GRID, TRAIN_GRID
from kairos.operators.sampling import MIN_SIDE, MODULUS, ROUNDS, SIDES


def isin(col: str) -> str:
    return f"('P' || lpad(CAST({col} AS VARCHAR), 11, '0'))"


VIEWS: dict[str, str] = {
    "transactions": f"""
        SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                         CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                         strftime(l_shipdate, '%Y%m%d')) AS transactionID,
               CAST(o_custkey AS VARCHAR) AS customerID,
               {isin('l_partkey')} AS ISIN,
               CASE WHEN l_returnflag = 'R' THEN 'Sell' ELSE 'Buy' END AS transactionType,
               l_extendedprice AS totalValue,
               l_shipdate AS "timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "close_prices": f"""
        SELECT {isin('l_partkey')} AS ISIN, l_shipdate AS "timestamp",
               max(l_extendedprice / l_quantity) AS closePrice
        FROM lineitem GROUP BY 1, 2""",
    "customer_information": """
        SELECT CAST(c_custkey AS VARCHAR) AS customerID, c_mktsegment AS customerType,
               CASE WHEN c_custkey % 2 = 1 THEN 'Predicted_' || r_name ELSE r_name END AS riskLevel,
               CASE WHEN c_acctbal < 0 THEN 'Low' WHEN c_acctbal < 3000 THEN 'Medium'
                    WHEN c_acctbal < 6000 THEN 'High' ELSE 'VeryHigh' END AS investmentCapacity,
               c_custkey * 2 AS _ingest_seq
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), c_mktsegment || '_REVISED', 'Predicted_' || r_name,
               'Unknown', c_custkey * 2 + 1
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_custkey % 7 = 0""",
    "asset_information": f"""
        SELECT {isin('p_partkey')} AS ISIN, p_type AS assetCategory, p_brand AS sector,
               CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS industry,
               p_partkey * 2 AS _ingest_seq
        FROM part WHERE p_partkey % 13 <> 0
        UNION ALL
        SELECT {isin('p_partkey')}, 'DUPLICATE', p_brand, NULL, p_partkey * 2 + 1
        FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 11 = 0""",
    "traits": """
        SELECT customerID,
               replace(arg_min(customerType, _ingest_seq), 'Predicted_', '') AS customerType,
               replace(arg_min(riskLevel, _ingest_seq), 'Predicted_', '') AS riskLevel,
               replace(arg_min(investmentCapacity, _ingest_seq), 'Predicted_', '') AS investmentCapacity
        FROM customer_information GROUP BY customerID""",
    "assets": """
        SELECT ISIN, arg_min(assetCategory, _ingest_seq) AS assetCategory,
               arg_min(sector, _ingest_seq) AS sector, arg_min(industry, _ingest_seq) AS industry
        FROM asset_information WHERE ISIN IS NOT NULL GROUP BY ISIN""",
    "train_grid": TRAIN_GRID.sql(),
    "test_grid": TEST_GRID.sql(),
}

ORDER = list(VIEWS)


def purchases_sql(grid: str) -> str:
    return f"""
        SELECT DISTINCT g.k, g.cutoff, t.customerID, t.ISIN
        FROM transactions t JOIN {grid} g
          ON t."timestamp" > g.cutoff AND t."timestamp" <= g.cutoff + INTERVAL {HORIZON_DAYS} DAY
        WHERE t.transactionType = 'Buy'"""


def start_sql(grid: str) -> str:
    return f"""
        SELECT g.k, g.cutoff, p.ISIN, arg_max(p.closePrice, p."timestamp") AS start_price
        FROM close_prices p JOIN {grid} g ON p."timestamp" <= g.cutoff
        WHERE p.closePrice IS NOT NULL GROUP BY ALL"""


def end_sql(grid: str) -> str:
    return f"""
        SELECT g.k, g.cutoff, p.ISIN, arg_max(p.closePrice, p."timestamp") AS end_price
        FROM close_prices p JOIN {grid} g
          ON p."timestamp" > g.cutoff AND p."timestamp" <= g.cutoff + INTERVAL {HORIZON_DAYS} DAY
        WHERE p.closePrice IS NOT NULL GROUP BY ALL"""


def profitable_sql(grid: str) -> str:
    return f"""
        SELECT s.k, s.cutoff, s.ISIN, s.start_price, e.end_price
        FROM ({start_sql(grid)}) s JOIN ({end_sql(grid)}) e ON s.k = e.k AND s.ISIN = e.ISIN
        WHERE e.end_price > s.start_price"""


def good_sql(grid: str) -> str:
    return f"""
        SELECT pu.* FROM ({purchases_sql(grid)}) pu
        WHERE EXISTS (SELECT 1 FROM ({profitable_sql(grid)}) pr WHERE pr.k = pu.k AND pr.ISIN = pu.ISIN)"""


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix every adapter view (unused CTEs cost DuckDB nothing)."""
    ctes = dict(VIEWS)
    ctes.update(extra or {})
    head = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        # Body brings its own CTEs: continue the same WITH list.
        return f"WITH {head},\n{stripped[4:]}"
    return f"WITH {head}\n{body}"


def shape_sql(n: str) -> str:
    """(a, b, spare) of a population's grid, as in ``sampling.order_shape``; ``n`` is a column of the row selected from."""
    side = f"greatest({MIN_SIDE}, ceil(sqrt({n})))::BIGINT"
    return f"""list_min(list_transform(range(0, least({SIDES}, ({side} - 1) // 2) + 1), lambda i: {{
               'spare': ({side} + i) * greatest({MIN_SIDE}, ({n} + {side} + i - 1) // ({side} + i)) - {n}, 'a': {side} + i,
               'b': greatest({MIN_SIDE}, ({n} + {side} + i - 1) // ({side} + i))}}))"""


def keys_sql(seed, key: str) -> str:
    """List of the round keys of a key's own order; worked out before entries are listed."""
    words = [f"('0x' || substr({sql_hash(f'{seed}|order{i}', key)}, {1 + 7 * k}, 7))::BIGINT" for i in range(ROUNDS // 4) for k in range(4)]
    return "[" + ", ".join(words) + "]"


def drawn_sql(rel: str, j: str = "j", shape: str = "s", keys: str = "keys") -> str:
    """``rel`` with ``pos``: the position of entry ``j`` of the order with ``keys`` over the grid in struct ``shape``.

    A subquery per step and a list at the end: an alias used three times in
    each of eight rounds, or a filter pushed below them, would be written out
    thousands of times.
    """
    q = f"SELECT *, {j} // {shape}.b AS _u, {j} % {shape}.b AS _v FROM ({rel})"
    for i in range(ROUNDS):
        q = f"SELECT *, (_v + {keys}[{i + 1}]) % {MODULUS} AS _x FROM ({q})"
        mixed = f"(_u + _x * _x % {MODULUS} * _x % {MODULUS}) % {shape}.{'ab'[i % 2]}"
        q = f"SELECT * EXCLUDE (_u, _v, _x), _v AS _u, {mixed} AS _v FROM ({q})"
    return f"SELECT * EXCLUDE (_u, _v), unnest([_u * {shape}.b + _v]) AS pos FROM ({q})"

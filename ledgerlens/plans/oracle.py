"""DuckDB SQL for the correctness oracle.

One shared CTE chain mirrors the Spark plan stage by stage: ``raw`` (the
dirty fixture), ``d`` (distinct), ``i`` (ids present), ``p`` (parsed
timestamp), ``cl`` (rule tag), ``t`` (cleaned transactions), ``c``
(customer aggregate), ``r`` (RFM base), ``k`` (ranks), ``s`` (scores),
``g`` / ``gf`` (segments, last / first match). Each key adds its own final
SELECT. Only dialect points differ from the Spark side: date parsing
(``try_cast``) and whole days (``epoch`` of the interval).
"""

from __future__ import annotations

CUTOFF = "2001-06-30 00:00:00"


def _seg_case(mode: str) -> str:
    rules = [
        ("High Value", "recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4"),
        ("Loyal", "recency_score >= 3 AND frequency_score >= 4 AND monetary_score >= 3"),
        ("New", "recency_score >= 4 AND frequency_score <= 2 AND monetary_score >= 2"),
        ("At Risk", "recency_score <= 2 AND frequency_score >= 3 AND monetary_score >= 2"),
        ("Low Engagement", "recency_score <= 2 AND frequency_score <= 2 AND monetary_score <= 2"),
    ]
    if mode == "last_match":
        rules = list(reversed(rules))
    whens = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules)
    return f"CASE {whens} ELSE 'Other' END"


def _bin(rn: str) -> str:
    return f"CASE WHEN n > 1 THEN greatest(1, (5 * ({rn} - 1) + n - 2) // (n - 1)) END"


BASE_CTES = f"""
raw0 AS (
  SELECT CASE WHEN o.o_orderkey % 11 = 0 THEN 'C' || CAST(o.o_orderkey AS VARCHAR)
              ELSE CAST(o.o_orderkey AS VARCHAR) END AS invoiceno,
         CAST(l.l_partkey AS VARCHAR) AS stockcode, p.p_name AS description,
         CASE WHEN l.l_returnflag = 'R' AND l.l_partkey % 7 = 0 THEN -CAST(l.l_quantity AS INTEGER)
              ELSE CAST(l.l_quantity AS INTEGER) END AS quantity,
         CASE WHEN o.o_orderkey % 53 = 0 THEN 'not-a-date' ELSE CAST(o.o_orderdate AS VARCHAR) END AS invoicedate,
         CASE WHEN l.l_partkey % 41 = 0 THEN CAST(0 AS DECIMAL(12,2))
              ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END AS unitprice,
         CASE WHEN o.o_orderkey % 17 = 0 THEN NULL WHEN o.o_orderkey % 19 = 0 THEN ''
              WHEN o.o_orderkey % 23 = 0 THEN 'NaN' ELSE CAST(o.o_custkey AS VARCHAR) END AS customerid,
         n.n_name AS country, l.l_orderkey AS k
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
       JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
raw AS (
  SELECT invoiceno, stockcode, description, quantity, invoicedate, unitprice, customerid, country FROM raw0
  UNION ALL
  SELECT invoiceno, stockcode, description, quantity, invoicedate, unitprice, customerid, country FROM raw0
  WHERE k % 29 = 0),
d AS (SELECT DISTINCT * FROM raw),
i AS (SELECT * FROM d WHERE customerid IS NOT NULL AND customerid <> '' AND lower(customerid) <> 'nan'),
p AS (SELECT *, try_cast(invoicedate AS TIMESTAMP) AS ts FROM i),
cl AS (SELECT *, CASE WHEN quantity IS NULL OR quantity <= 0 THEN 3
                      WHEN unitprice IS NULL OR unitprice <= 0 THEN 4
                      WHEN ts IS NULL OR ts > TIMESTAMP '{CUTOFF}' THEN 5
                      WHEN invoiceno LIKE 'C%' THEN 6 ELSE 0 END AS rule FROM p),
t AS (SELECT invoiceno, stockcode, description, quantity, ts AS invoicedate, unitprice,
             CAST(trim(customerid) AS BIGINT) AS customerid, country, quantity * unitprice AS total_revenue
      FROM cl WHERE rule = 0),
c AS (SELECT customerid, max(invoicedate) AS last_purchase, count(DISTINCT invoiceno) AS frequency,
             sum(total_revenue) AS monetary FROM t GROUP BY customerid),
ref AS (SELECT max(last_purchase) + INTERVAL 1 DAY AS ref_ts FROM c),
r AS (SELECT customerid, CAST(floor(epoch(ref_ts - last_purchase) / 86400) AS BIGINT) AS recency,
             frequency, monetary FROM c, ref WHERE frequency > 0 AND monetary > 0),
k AS (SELECT *, count(*) OVER () AS n,
             row_number() OVER (ORDER BY recency, customerid) AS rn_r,
             row_number() OVER (ORDER BY frequency, customerid) AS rn_f,
             row_number() OVER (ORDER BY monetary, customerid) AS rn_m FROM r),
s0 AS (SELECT customerid, recency, frequency, monetary, rn_r, rn_f, rn_m, n,
              CAST(6 - {_bin('rn_r')} AS INTEGER) AS recency_score,
              CAST({_bin('rn_f')} AS INTEGER) AS frequency_score,
              CAST({_bin('rn_m')} AS INTEGER) AS monetary_score FROM k),
s AS (SELECT *, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) || CAST(monetary_score AS VARCHAR)
                AS rfm_score,
             CAST(recency_score * 100 + frequency_score * 10 + monetary_score AS INTEGER) AS rfm_total FROM s0),
g AS (SELECT *, {_seg_case('last_match')} AS segment FROM s),
gf AS (SELECT *, {_seg_case('first_match')} AS segment FROM s)
"""


def with_chain(select: str) -> str:
    return f"WITH {BASE_CTES.strip()}\n{select.strip()}"


def pct(part: str, whole: str) -> str:
    """Same arithmetic as the Spark side: part * 100 / whole in double."""
    return f"CAST({part} AS DOUBLE) * 100 / CAST({whole} AS DOUBLE)"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"

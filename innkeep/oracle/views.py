"""Oracle-side definitions of the fixture views (DuckDB SQL).

Same rows as ``innkeep.sources.fixtures`` (see FIXTURES.md).  The driver
registers only the base tables, so each oracle query is prefixed with
the ``WITH`` blocks it needs (:func:`with_views`)."""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {}

VIEW_SQL["dim_n"] = """
SELECT COUNT(*) AS n FROM supplier
"""

VIEW_SQL["hotels"] = """
SELECT s_suppkey AS id,
       'HOT' || LPAD(CAST(s_suppkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(s_suppkey + 1 AS STRING))) AS INT), '0') AS hotel_id,
       s_name AS hotel_name,
       CASE WHEN s_suppkey % 40 = 39 THEN NULL ELSE n_name END AS city,
       r_name AS country,
       CAST(NULL AS INT) AS star_rating,
       CAST(CASE WHEN s_suppkey % 20 = 7 THEN 2 ELSE 20 + s_suppkey % 5 END AS INT) AS total_rooms,
       (SELECT MIN(o_orderdate) FROM orders) + INTERVAL '1' HOUR * CAST((s_suppkey * 7919) % 1009 AS INT) AS created_at
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEW_SQL["rooms"] = """
SELECT p_partkey AS id,
       'ROOM' || LPAD(CAST(p_partkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(p_partkey + 1 AS STRING))) AS INT), '0') AS room_id,
       'HOT' || LPAD(CAST(p_partkey % n - (CASE WHEN p_partkey % n % 25 = 24 THEN 1 ELSE 0 END) + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(p_partkey % n - (CASE WHEN p_partkey % n % 25 = 24 THEN 1 ELSE 0 END) + 1 AS STRING))) AS INT), '0') AS hotel_id,
       CAST(100 + CAST(FLOOR(p_partkey / n) AS BIGINT) AS STRING) || (CASE WHEN p_partkey % n % 25 = 24 THEN 'B' ELSE '' END) AS room_number,
       CASE WHEN p_type IN ('PROMO','LARGE') THEN 'Suite' WHEN p_type IN ('MEDIUM','ECONOMY') THEN 'Deluxe' ELSE 'Standard' END AS room_type,
       CASE WHEN p_size = 50 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS price_per_night,
       (p_size % 3 <> 0) AS is_available
FROM part CROSS JOIN dim_n
"""

VIEW_SQL["customers"] = """
SELECT c_custkey AS id,
       'CUST' || LPAD(CAST(c_custkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(c_custkey + 1 AS STRING))) AS INT), '0') AS customer_id,
       c_name AS full_name, n_name AS city, r_name AS country,
       CASE WHEN c_custkey % 31 = 30 THEN NULL WHEN c_custkey % 29 = 28 THEN 'guest ' || CAST(c_custkey AS STRING) || ' at example.com'
            ELSE 'guest' || CAST(c_custkey - CASE WHEN c_custkey % 37 = 36 THEN 1 ELSE 0 END AS STRING) || '@example.com' END AS email,
       CASE WHEN c_custkey % 41 = 40 THEN NULL WHEN c_custkey % 43 = 42 THEN '+49 30 1234 5678 9012 ' || CAST(c_custkey AS STRING)
            ELSE '+49 30 ' || CAST(100000 + c_custkey AS STRING) END AS phone
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEW_SQL["bookings"] = """
SELECT o_orderkey AS id,
       'BOOK' || LPAD(CAST(o_orderkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_orderkey + 1 AS STRING))) AS INT), '0') AS booking_id,
       CASE WHEN o_orderkey % 97 = 96 THEN 'CUST00000' ELSE 'CUST' || LPAD(CAST(o_custkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_custkey + 1 AS STRING))) AS INT), '0') END AS customer_id,
       CASE WHEN o_orderkey % 50 = 49 THEN 'HOT00000' ELSE 'HOT' || LPAD(CAST(o_orderkey % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_orderkey % n + 1 AS STRING))) AS INT), '0') END AS hotel_id,
       CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Cancelled' WHEN o_orderstatus = 'O' THEN 'Confirmed' ELSE 'Completed' END AS booking_status,
       o_orderdate AS created_at
FROM orders CROSS JOIN dim_n
"""

VIEW_SQL["booking_rooms"] = """
SELECT 'BR' || CAST(l_orderkey AS STRING) || '-' || CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS STRING) AS booking_room_id,
       'BOOK' || LPAD(CAST(l_orderkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(l_orderkey + 1 AS STRING))) AS INT), '0') AS booking_id,
       CAST(100 + CAST(FLOOR(l_partkey / n) AS BIGINT) AS STRING) AS room_number,
       CAST(l_shipdate AS DATE) AS check_in,
       CAST(l_shipdate + INTERVAL '1' DAY * CAST(l_quantity AS INT) AS DATE) AS check_out,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS room_amount
FROM lineitem CROSS JOIN dim_n
"""

VIEW_SQL["bookings_cancelled"] = """
SELECT 'BOOKCANCEL' || CAST(id * 2 + k AS STRING) AS booking_cancel_id, booking_id, customer_id, hotel_id, total_amount,
       CASE WHEN k = 0 THEN o_orderpriority ELSE 'second request' END AS cancel_reason
FROM bookings JOIN orders ON id = o_orderkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks
WHERE o_orderstatus = 'F' AND (k = 0 OR id % 20 = 0)
"""

VIEW_SQL["reviews"] = """
SELECT event_id AS id,
       'REV' || LPAD(CAST(event_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id + 1 AS STRING))) AS INT), '0') AS review_id,
       'HOT' || LPAD(CAST(event_id % n - (CASE WHEN event_id % n % 10 = 9 THEN 1 ELSE 0 END) + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id % n - (CASE WHEN event_id % n % 10 = 9 THEN 1 ELSE 0 END) + 1 AS STRING))) AS INT), '0') AS hotel_id,
       CASE WHEN event_id % 17 = 0 THEN 'CUST00000' ELSE 'CUST' || LPAD(CAST(user_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(user_id + 1 AS STRING))) AS INT), '0') END AS customer_id,
       CAST(1 + CAST(FLOOR(value) AS INT) % 5 AS INT) AS rating,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS comment,
       CAST(ts AS DATE) AS review_date
FROM events CROSS JOIN dim_n
"""

VIEW_SQL["services"] = """
SELECT 'SERV' || LPAD(CAST((p_partkey % n) * 6 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS STRING), CAST(GREATEST(5, LENGTH(CAST((p_partkey % n) * 6 + CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS STRING))) AS INT), '0') AS service_id,
       'HOT' || LPAD(CAST(p_partkey % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(p_partkey % n + 1 AS STRING))) AS INT), '0') AS hotel_id,
       p_type AS service_name, CAST(MIN(p_size) AS DECIMAL(10,2)) AS service_charge
FROM part CROSS JOIN dim_n GROUP BY p_partkey % n, p_type
"""

VIEW_SQL["employees"] = """
SELECT 'EMP' || LPAD(CAST(c_custkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(c_custkey + 1 AS STRING))) AS INT), '0') AS employee_id,
       'HOT' || LPAD(CAST(c_custkey % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(c_custkey % n + 1 AS STRING))) AS INT), '0') AS hotel_id, c_name AS full_name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'employee' ELSE LOWER(c_mktsegment) END AS role,
       CAST(c_acctbal AS DECIMAL(10,2)) AS salary, CAST(CAST('2015-01-01' AS DATE) + INTERVAL '1' DAY * CAST(c_custkey % 3000 AS INT) AS DATE) AS hire_date
FROM customer CROSS JOIN dim_n
"""

VIEW_SQL["maintenance"] = """
SELECT 'MAINTAIN' || LPAD(CAST(event_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id + 1 AS STRING))) AS INT), '0') AS maintenance_id,
       'HOT' || LPAD(CAST(event_id % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id % n + 1 AS STRING))) AS INT), '0') AS hotel_id,
       CAST(100 + user_id % 20 AS STRING) AS room_number,
       'EMP' || LPAD(CAST(user_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(user_id + 1 AS STRING))) AS INT), '0') AS employee_id,
       props AS issue_description, CAST(ts AS DATE) AS maintenance_date,
       CASE event_id % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Completed' ELSE 'Cancelled' END AS maintenance_status
FROM events CROSS JOIN dim_n WHERE event_type = 'error'
"""

VIEW_SQL["hotel_requests"] = """
SELECT s_suppkey AS request_seq,
       CASE WHEN s_suppkey % 10 = 4 THEN 'HOT' || LPAD(CAST(s_suppkey - 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(s_suppkey - 1 AS STRING))) AS INT), '0') WHEN s_suppkey % 2 = 0 THEN 'HOT' || LPAD(CAST(s_suppkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(s_suppkey + 1 AS STRING))) AS INT), '0') ELSE NULL END AS hotel_id,
       CASE WHEN s_suppkey % 11 = 10 THEN '' ELSE s_name || ' v2' END AS hotel_name, n_name AS city, r_name AS country,
       CASE WHEN s_suppkey % 13 = 12 THEN '12.345' ELSE CAST(15 + s_suppkey % 10 AS STRING) END AS total_rooms
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

VIEW_SQL["hotel_request_rooms"] = """
SELECT p_partkey % n AS request_seq, p_partkey AS pos,
       CAST(110 + CAST(FLOOR(p_partkey / n) AS BIGINT) % CASE WHEN p_partkey % n % 3 = 0 THEN 19 ELSE 23 END AS STRING) AS room_number,
       CASE WHEN p_type IN ('PROMO','LARGE') THEN 'Suite' WHEN p_type IN ('MEDIUM','ECONOMY') THEN 'Deluxe' ELSE 'Standard' END AS room_type,
       CAST(p_retailprice AS STRING) AS price_per_night,
       CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size % 2 = 0 END AS is_available
FROM part CROSS JOIN dim_n
"""

VIEW_SQL["hotel_request_services"] = """
SELECT p_partkey % n AS request_seq, p_partkey AS pos,
       CASE WHEN p_size % 10 = 0 THEN 'SERV' || LPAD(CAST((p_partkey % n) * 6 + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST((p_partkey % n) * 6 + 1 AS STRING))) AS INT), '0') ELSE NULL END AS service_id,
       CASE WHEN p_size % 9 = 0 THEN '' WHEN p_size % 2 = 0 THEN p_brand || (CASE WHEN p_partkey % n % 5 = 2 THEN '' ELSE '-' || CAST(CAST(FLOOR(p_partkey / n) AS BIGINT) AS STRING) END) ELSE LOWER(p_brand || (CASE WHEN p_partkey % n % 5 = 2 THEN '' ELSE '-' || CAST(CAST(FLOOR(p_partkey / n) AS BIGINT) AS STRING) END)) END AS service_name,
       CASE WHEN p_size % 23 = 0 AND p_partkey % n % 4 = 1 THEN NULL ELSE CAST(p_size AS STRING) END AS service_charge
FROM part CROSS JOIN dim_n
"""

VIEW_SQL["booking_requests"] = """
SELECT o_orderkey AS request_seq,
       'CUST' || LPAD(CAST(o_custkey + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_custkey + 1 AS STRING))) AS INT), '0') AS customer_id,
       CASE WHEN o_orderkey % 90 = 0 THEN 'HOT00000' ELSE 'HOT' || LPAD(CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(CAST(FLOOR(o_orderkey / 10) AS BIGINT) % n + 1 AS STRING))) AS INT), '0') END AS hotel_id,
       CASE WHEN o_orderkey % 130 = 0 THEN 'abc' ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS STRING) END AS total_amount,
       CASE WHEN o_orderkey % 170 = 0 THEN 'Unknown' ELSE NULL END AS booking_status
FROM orders CROSS JOIN dim_n
"""

VIEW_SQL["booking_request_rooms"] = """
SELECT l_orderkey AS request_seq,
       ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
       CAST(100 + CAST(FLOOR(l_partkey / n) AS BIGINT) + CASE WHEN l_tax > 0.075 THEN 500 ELSE 0 END AS STRING) AS room_number,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS check_in,
       CASE WHEN l_linenumber = 7 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE CAST(CAST(l_shipdate + INTERVAL '1' DAY * CAST(l_quantity AS INT) AS DATE) AS STRING) END AS check_out,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS STRING) AS room_amount
FROM lineitem CROSS JOIN dim_n
"""

VIEW_SQL["cancel_requests"] = """
SELECT o_orderkey AS request_seq,
       'BOOK' || LPAD(CAST(o_orderkey * 2 + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_orderkey * 2 + 1 AS STRING))) AS INT), '0') AS booking_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'CUST00001' ELSE 'CUST' || LPAD(CAST(c2 + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(c2 + 1 AS STRING))) AS INT), '0') END AS customer_id,
       CASE WHEN o_orderkey % 49 = 0 THEN 'HOT00000' ELSE 'HOT' || LPAD(CAST(o_orderkey * 2 % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_orderkey * 2 % n + 1 AS STRING))) AS INT), '0') END AS hotel_id,
       CASE WHEN o_orderkey % 4 = 0 THEN 'no' ELSE o_orderpriority || ' plans changed' END AS cancel_reason,
       CASE WHEN o_orderkey % 23 = 22 THEN 'BOOKCANCEL-' || CAST(o_orderkey * 1000003 + 1000000000 AS STRING)
            WHEN o_orderkey % 3 = 0 THEN 'BOOKCANCEL' || LPAD(CAST(o_orderkey AS STRING), CAST(GREATEST(5, LENGTH(CAST(o_orderkey AS STRING))) AS INT), '0') END AS booking_cancel_id
FROM orders LEFT JOIN (SELECT o_orderkey AS k2, o_custkey AS c2 FROM orders) x ON o_orderkey * 2 = k2 CROSS JOIN dim_n
"""

VIEW_SQL["review_requests"] = """
SELECT event_id AS request_seq,
       CASE WHEN event_id % 19 = 0 THEN 'HOT00000' ELSE 'HOT' || LPAD(CAST(event_id % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id % n + 1 AS STRING))) AS INT), '0') END AS hotel_id,
       CASE WHEN event_id % 23 = 0 THEN 'CUST00000' ELSE 'CUST' || LPAD(CAST(user_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(user_id + 1 AS STRING))) AS INT), '0') END AS customer_id,
       CASE event_id % 8 WHEN 0 THEN '6' WHEN 1 THEN '4.5' WHEN 2 THEN '0' WHEN 3 THEN '3.125' WHEN 4 THEN '' ELSE CAST(event_id % 5 + 1 AS STRING) END AS rating,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE ' ' || props || ' ' END AS comment
FROM events CROSS JOIN dim_n WHERE event_type = 'purchase'
"""

VIEW_SQL["maintenance_requests"] = """
SELECT CAST(FLOOR(event_id / 3) AS BIGINT) AS request_seq, event_id AS pos,
       'HOT' || LPAD(CAST(CAST(FLOOR(event_id / 3) AS BIGINT) % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(CAST(FLOOR(event_id / 3) AS BIGINT) % n + 1 AS STRING))) AS INT), '0') AS hotel_id,
       'EMP' || LPAD(CAST(CAST(FLOOR(event_id / 3) AS BIGINT) % (n * 15) + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(CAST(FLOOR(event_id / 3) AS BIGINT) % (n * 15) + 1 AS STRING))) AS INT), '0') AS employee_id,
       CAST(100 + event_id % 21 AS STRING) AS room_number,
       CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE 'issue ' || props END AS issue_description,
       CASE WHEN event_id % 37 = 0 THEN 'not a date' ELSE CAST(CAST(ts AS DATE) AS STRING) END AS maintenance_date,
       CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'Unknown' ELSE 'Completed' END AS maintenance_status,
       CASE WHEN event_id % 43 = 42 THEN 'MAINTENANCE-' || CAST(event_id + 1000000000 AS STRING)
            WHEN event_id % 2 = 0 THEN 'MAINTAIN' || LPAD(CAST(event_id AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id AS STRING))) AS INT), '0') END AS maintenance_id
FROM events CROSS JOIN dim_n WHERE event_type IN ('view', 'click')
"""

VIEW_SQL["maintenance_updates"] = """
SELECT event_id * 2 + k AS request_seq,
       'MAINTAIN' || LPAD(CAST(event_id + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id + 1 AS STRING))) AS INT), '0') AS maintenance_id,
       'HOT' || LPAD(CAST(event_id % n + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST(event_id % n + 1 AS STRING))) AS INT), '0') AS hotel_id,
       CAST(100 + user_id % 20 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS STRING) AS room_number,
       'EMP' || LPAD(CAST((event_id + k) % (n * 15) + 1 AS STRING), CAST(GREATEST(5, LENGTH(CAST((event_id + k) % (n * 15) + 1 AS STRING))) AS INT), '0') AS employee_id,
       CASE (event_id + k * (event_id % 2)) % 4 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Completed' WHEN 2 THEN 'Cancelled' ELSE 'Unknown' END AS maintenance_status
FROM events CROSS JOIN dim_n CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) ks
WHERE event_type IN ('error', 'signup') AND (k = 0 OR event_id % 3 = 0)
"""


VIEW_ORDER = list(VIEW_SQL)


def _refs(text: str) -> set[str]:
    return {v for v in VIEW_ORDER if re.search(r"\b%s\b" % v, text)}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the WITH blocks of every fixture view it uses
    (transitively), in definition order."""
    need: set[str] = set()
    todo = list(_refs(sql))
    while todo:
        v = todo.pop()
        if v in need:
            continue
        need.add(v)
        todo.extend(_refs(VIEW_SQL[v]) - need - {v})
    if not need:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in VIEW_ORDER if v in need)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"

"""SQL text of the fixture views and of shared derived tables, for the DuckDB
oracle.  ``with_views(sql)`` prepends, as CTEs, every view the query names
(and the views those depend on), so each oracle string is self-contained and
runs on the driver's pre-registered base tables.
"""

from __future__ import annotations

import re


def _score(mult: int) -> str:
    return (f"CASE WHEN c.c_custkey % 11 = 0 THEN NULL "
            f"ELSE 3E0 + ((c.c_custkey * {mult}) % 200) / 100E0 END")


# Views in dependency order (a view may only use views defined above it).
VIEWS: dict[str, str] = {}

VIEWS["fx_listings"] = f"""
SELECT c.c_custkey AS id, r.r_name AS borough, n.n_name AS neighbourhood, c.c_mktsegment AS property_type,
       CASE c.c_custkey % 4 WHEN 0 THEN 'Shared room' WHEN 1 THEN 'Hotel room'
                            WHEN 2 THEN 'Private room' ELSE 'Entire home/apt' END AS room_type,
       40.5E0  + ((c.c_custkey * 7919)   % 10007) / 10007E0 * 0.4E0 AS latitude,
       -74.2E0 + ((c.c_custkey * 104729) % 10009) / 10009E0 * 0.5E0 AS longitude,
       CASE WHEN c.c_custkey % 9 = 0 THEN NULL
            WHEN c.c_custkey % 50 = 1 THEN 'n/a'
            ELSE '$' || CAST(c.c_custkey % 3 AS VARCHAR) || ','
                 || lpad(CAST((c.c_custkey * 37) % 1000 AS VARCHAR), 3, '0') || '.50' END AS price,
       CAST((c.c_custkey * 7) % 60 AS INTEGER) AS minimum_nights,
       CAST(1 + c.c_custkey % 6 AS INTEGER) AS accommodates,
       CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE CAST(c.c_custkey % 5 AS DOUBLE) END AS bedrooms,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE CAST(1 + c.c_custkey % 4 AS DOUBLE) END AS beds,
       {_score(1)} AS review_scores_rating,
       {_score(3)} AS review_scores_accuracy,
       {_score(7)} AS review_scores_cleanliness,
       {_score(11)} AS review_scores_checkin,
       {_score(13)} AS review_scores_communication,
       {_score(17)} AS review_scores_location,
       {_score(19)} AS review_scores_value,
       CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(c.c_custkey % 101 AS VARCHAR) || '%' END AS host_response_rate,
       CASE WHEN c.c_custkey % 8 = 0 THEN NULL ELSE CAST((c.c_custkey * 3) % 101 AS VARCHAR) || '%' END AS host_acceptance_rate,
       CASE c.c_custkey % 5 WHEN 0 THEN 'within an hour' WHEN 1 THEN 'Within a few hours'
                            WHEN 2 THEN 'within a day' WHEN 3 THEN 'a few days or more' ELSE NULL END AS host_response_time,
       CASE c.c_custkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'f' ELSE NULL END AS host_is_superhost,
       CASE c.c_custkey % 3 WHEN 1 THEN 't' ELSE 'f' END AS host_identity_verified,
       CASE c.c_custkey % 2 WHEN 0 THEN 't' ELSE 'f' END AS instant_bookable,
       CASE WHEN c.c_custkey % 6 = 0 THEN 'LIC-' || CAST(c.c_custkey AS VARCHAR) ELSE NULL END AS license,
       CASE c.c_custkey % 5 WHEN 0 THEN 'Half-bath' WHEN 1 THEN '1.5 baths' WHEN 2 THEN '2 shared baths'
                            WHEN 3 THEN 'Shared half-bath' ELSE NULL END AS bathrooms_text,
       CASE c.c_custkey % 4 WHEN 0 THEN '["Wifi", "Hair dryer"]' WHEN 1 THEN '["Dishwasher", "Pool", "Gym"]'
                            WHEN 2 THEN 'not json' ELSE NULL END AS amenities,
       CAST((c.c_custkey * 13) % 366 AS INTEGER) AS availability_365,
       CAST((c.c_custkey * 3) % 250 AS INTEGER) AS number_of_reviews,
       CAST(c.c_custkey % 40 AS INTEGER) AS number_of_reviews_ltm,
       CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE ((c.c_custkey * 3) % 500) / 100E0 END AS reviews_per_month,
       CAST((c.c_custkey * 29) % 256 AS DOUBLE) AS estimated_occupancy,
       c.c_acctbal AS estimated_revenue
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""

VIEWS["fx_stations"] = """
SELECT s_suppkey AS ref_id,
       40.5E0  + ((s_suppkey * 6151)  % 1009) / 1009E0 * 0.4E0 AS latitude,
       -74.2E0 + ((s_suppkey * 12289) % 1013) / 1013E0 * 0.5E0 AS longitude,
       CAST(s_nationkey % 2 AS INTEGER) AS cbd, CAST(s_nationkey % 3 AS INTEGER) AS ada,
       CASE s_nationkey % 4 WHEN 0 THEN 'A C E' WHEN 1 THEN 'N W' WHEN 2 THEN '7' ELSE NULL END AS routes
FROM supplier
"""

VIEWS["fx_points"] = """
SELECT p_partkey AS ref_id, p_type AS domain,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 40.5E0 + ((p_partkey * 6151) % 10007) / 10007E0 * 0.4E0 END AS latitude,
       -74.2E0 + ((p_partkey * 12289) % 10009) / 10009E0 * 0.5E0 AS longitude
FROM part
"""

VIEWS["fx_monthly_prices"] = """
SELECT o_custkey AS id, CAST(month(o_orderdate) AS INTEGER) AS month, min(o_totalprice) / 100E0 AS price_numeric
FROM orders GROUP BY o_custkey, CAST(month(o_orderdate) AS INTEGER)
"""

VIEWS["fx_reviews"] = """
SELECT o_orderkey AS review_id, o_custkey AS listing_id, o_orderkey % 997 AS reviewer_id,
       CAST(o_orderdate AS DATE) AS date
FROM orders
"""

VIEWS["fx_comments"] = """
SELECT doc_id AS review_id, source AS listing_id, text AS comments, lang AS language FROM documents
"""

VIEWS["fx_comment_topics"] = """
SELECT event_id AS review_id, user_id AS listing_id,
       CAST(CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN 0 WHEN 'view' THEN 1
                            WHEN 'signup' THEN 2 ELSE 3 END AS INTEGER) AS topic
FROM events
"""

VIEWS["fx_predictions"] = """
SELECT l_orderkey AS id, l_linenumber AS line, CAST(month(l_shipdate) AS INTEGER) AS month,
       CAST(l_orderkey % 5 AS INTEGER) AS fold, l_extendedprice / 100E0 AS true_price,
       l_extendedprice / 100E0 * (1E0 - l_discount + l_tax) AS pred_price
FROM lineitem
"""

VIEWS["fx_contributions"] = """
SELECT l_orderkey AS id, l_linenumber AS line, l_discount - 0.05E0 AS c_discount, l_tax - 0.04E0 AS c_tax,
       (l_quantity - 25E0) / 100E0 AS c_quantity
FROM lineitem
"""

VIEWS["fx_snapshots"] = """
SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price_numeric,
       CAST((o_orderkey * 7) % 60 AS INTEGER) AS minimum_nights
FROM orders
"""

VIEWS["fx_arrests"] = """
SELECT l_orderkey * 10 + l_linenumber AS ref_id, l_returnflag AS offense,
       CASE l_linenumber % 6 WHEN 0 THEN 'B' WHEN 1 THEN 'M' WHEN 2 THEN 'Q' WHEN 3 THEN 'K' WHEN 4 THEN 'S'
                             ELSE 'X' END AS boro_letter,
       CASE WHEN l_orderkey % 23 = 0 THEN NULL
            ELSE 40.5E0 + ((l_orderkey * 31 + l_linenumber * 7919) % 10007) / 10007E0 * 0.4E0 END AS latitude,
       -74.2E0 + ((l_orderkey * 17 + l_linenumber * 104729) % 10009) / 10009E0 * 0.5E0 AS longitude
FROM lineitem
"""


def register(name: str, sql: str) -> None:
    """Add a derived view (must only use views registered before it)."""
    VIEWS[name] = sql


def _deps(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in needed:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                visit(d)
        needed.append(name)

    for v in _deps(sql):
        visit(v)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in needed)
    body = sql.strip()
    m = re.match(r"(?is)^with\s+(recursive\s+)?", body)
    if m:
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"

"""SQL parts that several oracles share."""

#: Offers of the test tables: the latest line per (part, supplier), its state, price and freshness.
OFFERS = """
latest AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM lineitem
), crawl AS (
  SELECT l_suppkey AS suppkey, max(l_shipdate) - INTERVAL 365 DAY AS since FROM lineitem GROUP BY l_suppkey
), offers AS (
  SELECT l_partkey AS part_key, l_suppkey AS supplier_key, l_orderkey * 10 + l_linenumber AS offer_id,
    CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) * 100) // CAST(l_quantity AS BIGINT)) / 10000.0 AS DECIMAL(18,4)) AS price,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'in_stock' WHEN l_returnflag = 'N' THEN 'preorder'
      WHEN l_linestatus = 'O' THEN 'backorder' WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE 'discontinued' END AS availability,
    s_nationkey % 2 AS priority, l_shipdate >= since AS fresh, l_shipdate AS ship, l_quantity AS quantity
  FROM latest JOIN supplier ON l_suppkey = s_suppkey JOIN crawl ON l_suppkey = suppkey WHERE rn = 1
), ranked AS (
  SELECT *, CASE availability WHEN 'in_stock' THEN 0 WHEN 'preorder' THEN 2 WHEN 'backorder' THEN 2 WHEN 'out_of_stock' THEN 4 ELSE 5 END AS rank,
    availability <> 'discontinued' AND fresh AS ok
  FROM offers
), counted AS (
  SELECT part_key, count(*) AS evaluated, count(*) FILTER (WHERE ok) AS eligible FROM ranked GROUP BY part_key
), a AS (
  SELECT *, min(rank) OVER (PARTITION BY part_key) AS best FROM ranked WHERE ok
), b AS (
  SELECT *, max(priority) OVER (PARTITION BY part_key) AS top FROM a WHERE rank = best
), c AS (
  SELECT *, count(*) OVER (PARTITION BY part_key) AS finalists, min(price) OVER (PARTITION BY part_key) AS low FROM b WHERE priority = top
), d AS (
  SELECT *, count(*) OVER (PARTITION BY part_key) AS cheapest,
    row_number() OVER (PARTITION BY part_key ORDER BY supplier_key, offer_id) AS pick
  FROM c WHERE price = low
), selection AS (
  SELECT n.part_key, CASE WHEN eligible = 0 THEN 'no_eligible_offer' ELSE 'selected' END AS status,
    CASE WHEN eligible = 0 THEN 'no_eligible_offer' WHEN eligible = 1 THEN 'single_eligible_current_offer'
      WHEN finalists = 1 THEN 'availability_and_supplier_priority_winner' WHEN cheapest = 1 THEN 'lowest_valid_price_within_top_business_rank'
      ELSE 'deterministic_tie_break_after_equal_business_inputs' END AS reason,
    d.offer_id, d.supplier_key, d.price, evaluated, eligible, d.availability, d.ship, d.quantity
  FROM counted n LEFT JOIN d ON d.part_key = n.part_key AND d.pick = 1
)
"""

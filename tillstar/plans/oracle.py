"""Independent SQL (DuckDB dialect) that rebuilds the same star from the raw
driver tables and answers the same questions. Used as the correctness oracle:
every registered Spark query with an entry here is compared against it.

The SQL shares no code with the Spark plans, only the fixed values of the
mapping (cost ratio, sheets, word lists), which are injected from Python.
"""

from __future__ import annotations

from tillstar.operators import clean, sentiment
from tillstar.plans import star as S


def M(x: str, s: int = 2) -> str:
    """Round half-up through DECIMAL(38,6), return double."""
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,6)), {s}) AS DOUBLE)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(
        "NULL" if v is None else (_q(v) if isinstance(v, str) else
                                  ("TRUE" if v is True else "FALSE" if v is False else repr(v)))
        for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


_LEX = _values([(t, v) for t, v in S.CORPUS_LEXICON], ["token", "valence"])
_WORDS = _values(
    [(w, 1, False, False) for w in S.CORPUS_BOOSTERS_UP]
    + [(w, -1, False, False) for w in S.CORPUS_BOOSTERS_DOWN]
    + [(w, None, True, False) for w in sentiment.NEGATIONS]
    + [("but", None, False, True)], ["token", "boost", "neg", "is_but"])
_PHRASES = _values(list(S.CORPUS_PHRASES), ["phrase", "valence"])
_SO = "('so', 'this')"
_SHIP = _values(list(S.SHIPPING_SHEET), ["region_name", "shipping_cost"])

ACC = "DECIMAL(30,12)"
_STEP = [f"CAST({sentiment.BOOSTER_INCREMENT} AS DECIMAL(6,3)) * CAST({d} AS DECIMAL(4,2))"
         for d in sentiment.BOOSTER_DECAY]


def _vk(k: int) -> str:
    prev = "v0" if k == 1 else f"v{k - 1}"
    return (f"CAST(({prev} + CAST(sign({prev}) AS DECIMAL(2,0)) * "
            f"CAST(CASE WHEN b{k}_ok THEN CAST(b{k} AS DECIMAL(2,0)) * {_STEP[k - 1]} ELSE 0 END AS DECIMAL(12,6)))"
            f" * CAST(CASE WHEN n{k} THEN CASE x{k} WHEN 1 THEN {sentiment.NEVER_SO_SCALAR} WHEN 2 THEN 1 "
            f"ELSE {sentiment.NEGATION_SCALAR} END ELSE 1 END AS DECIMAL(4,2)) AS {ACC})")


BASE = f"""
WITH
geo AS (
  SELECT n.n_nationkey AS nationkey, n.n_name AS city_name, r.r_name AS region
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS subcategory_name,
         p_type AS category_name, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
         CAST(ROUND(CAST(p_retailprice AS DECIMAL(12,2)) * CAST({S.COST_RATIO} AS DECIMAL(4,2)), 2)
              AS DECIMAL(12,2)) AS unit_cost
  FROM part),
reviews AS (
  SELECT doc_id AS review_id, doc_id % (SELECT count(*) FROM part) AS product_id,
         CAST(1 + doc_id % 5 AS DOUBLE) AS rating, text AS review_text
  FROM documents),
lex AS (
  SELECT lower(trim(token)) AS token, max(CAST(valence AS DECIMAL(8,4))) AS valence
  FROM {_LEX} WHERE valence <> 0 GROUP BY 1),
words AS (
  SELECT token, max(boost) AS boost, bool_or(neg) AS neg, bool_or(is_but) AS is_but
  FROM {_WORDS} GROUP BY token),
rules AS (
  SELECT coalesce(l.token, w.token) AS token, l.valence, w.boost, w.neg AS wneg, w.is_but AS wbut
  FROM lex l FULL OUTER JOIN words w ON l.token = w.token),
rv AS (
  SELECT review_id, product_id, rating,
         least(strlen(coalesce(review_text, '')) - strlen(replace(coalesce(review_text, ''), '!', '')),
               {sentiment.EXCLAMATION_MAX}) AS excl,
         strlen(coalesce(review_text, '')) - strlen(replace(coalesce(review_text, ''), '?', '')) AS qm,
         regexp_split_to_array(lower(trim(coalesce(review_text, ''))), '\\s+') AS arr
  FROM reviews),
tok0 AS (
  SELECT review_id, unnest(arr) AS raw, generate_subscripts(arr, 1) AS idx FROM rv),
tok1 AS (
  SELECT review_id, idx,
         regexp_replace(raw, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}'']+$', '', 'g') AS token
  FROM tok0),
tok AS (
  SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY idx) - 1 AS pos, token
  FROM tok1 WHERE token <> ''),
tokj AS (
  SELECT t.review_id, t.pos, t.token, r.valence, r.boost,
         coalesce(r.wneg, FALSE) OR coalesce(t.token LIKE '%n''t', FALSE) AS neg,
         coalesce(r.wbut, FALSE) AS is_but
  FROM tok t LEFT JOIN rules r ON t.token = r.token),
grams AS (
  SELECT review_id, pos, token || ' ' || lead(token, 1) OVER w AS g2,
         token || ' ' || lead(token, 1) OVER w || ' ' || lead(token, 2) OVER w AS g3
  FROM tok WINDOW w AS (PARTITION BY review_id ORDER BY pos)),
phr AS (
  SELECT review_id, pos, CASE WHEN c.phrase IS NOT NULL THEN 3 ELSE 2 END AS len,
         CAST(coalesce(c.valence, b.valence) AS DECIMAL(8,4)) AS pval
  FROM grams g LEFT JOIN {_PHRASES.replace("AS t(", "AS b(")} ON b.phrase = g.g2
       LEFT JOIN {_PHRASES.replace("AS t(", "AS c(")} ON c.phrase = g.g3
  WHERE b.phrase IS NOT NULL OR c.phrase IS NOT NULL),
held AS (
  SELECT * FROM phr p WHERE NOT EXISTS (
    SELECT 1 FROM phr q WHERE q.review_id = p.review_id AND q.pos < p.pos + p.len AND p.pos < q.pos + q.len
      AND (q.len > p.len OR q.len = p.len AND q.pos < p.pos))),
tokr AS (
  SELECT t.review_id, t.pos, t.token,
         CASE WHEN h.pos = t.pos THEN h.pval WHEN h.pos IS NULL THEN t.valence END AS valence,
         CASE WHEN h.pos IS NULL THEN t.boost END AS boost,
         t.neg AND h.pos IS NULL AS neg, t.is_but AND h.pos IS NULL AS is_but
  FROM tokj t LEFT JOIN held h ON h.review_id = t.review_id AND t.pos >= h.pos AND t.pos < h.pos + h.len),
ctx AS (
  SELECT review_id, pos, valence, boost, is_but,
         lag(boost, 1) OVER w AS b1, lag(boost, 2) OVER w AS b2, lag(boost, 3) OVER w AS b3,
         lag(valence, 1) OVER w IS NULL AND lag(boost, 1) OVER w IS NOT NULL AS b1_ok,
         lag(valence, 2) OVER w IS NULL AND lag(boost, 2) OVER w IS NOT NULL AS b2_ok,
         lag(valence, 3) OVER w IS NULL AND lag(boost, 3) OVER w IS NOT NULL AS b3_ok,
         coalesce(lag(neg, 1) OVER w, FALSE) AS n1,
         coalesce(lag(neg, 2) OVER w, FALSE) AS n2,
         coalesce(lag(neg, 3) OVER w, FALSE) AS n3,
         0 AS x1,
         CASE WHEN lag(token, 2) OVER w = 'never' AND lag(token, 1) OVER w IN {_SO} THEN 1
              WHEN lag(token, 2) OVER w = 'without' AND lag(token, 1) OVER w = 'doubt' THEN 2 ELSE 0 END AS x2,
         CASE WHEN lag(token, 3) OVER w = 'never' AND (lag(token, 1) OVER w IN {_SO} OR lag(token, 2) OVER w IN {_SO}) THEN 1
              WHEN lag(token, 3) OVER w = 'without' AND (lag(token, 1) OVER w = 'doubt' OR lag(token, 2) OVER w = 'doubt') THEN 2
              ELSE 0 END AS x3,
         coalesce(lag(token, 1) OVER w = 'least', FALSE)
           AND NOT coalesce(lag(token, 2) OVER w IN ('at', 'very'), FALSE) AS least
  FROM tokr WINDOW w AS (PARTITION BY review_id ORDER BY pos)),
v1 AS (SELECT *, CAST(CASE WHEN boost IS NULL THEN valence END AS {ACC}) AS v0 FROM ctx),
v2 AS (SELECT *, {_vk(1)} AS v1 FROM v1),
v3 AS (SELECT *, {_vk(2)} AS v2 FROM v2),
v4 AS (SELECT * EXCLUDE (v3), CAST(v3 * CAST(CASE WHEN least THEN {sentiment.NEGATION_SCALAR} ELSE 1 END AS DECIMAL(4,2)) AS {ACC}) AS v3
       FROM (SELECT *, {_vk(3)} AS v3 FROM v3)),
butp AS (SELECT review_id, min(pos) AS but_pos FROM tokr WHERE is_but GROUP BY review_id),
tsum AS (
  SELECT v.review_id,
         CAST(sum(CAST(v.v3 * CAST(CASE WHEN b.but_pos IS NULL OR v.pos = b.but_pos THEN 1.0
                                       WHEN v.pos < b.but_pos THEN {sentiment.BUT_BEFORE}
                                       ELSE {sentiment.BUT_AFTER} END AS DECIMAL(2,1)) AS {ACC}))
              AS {ACC}) AS total
  FROM v4 v LEFT JOIN butp b ON v.review_id = b.review_id
  WHERE v.v0 IS NOT NULL
  GROUP BY v.review_id),
scored0 AS (
  SELECT rv.review_id, rv.product_id, rv.rating, coalesce(ts.total, CAST(0 AS {ACC})) AS total,
         CAST(CAST(rv.excl AS DECIMAL(4,0)) * CAST({sentiment.EXCLAMATION_STEP} AS DECIMAL(4,3))
              + CASE WHEN rv.qm <= 1 THEN 0
                     WHEN rv.qm <= 3 THEN CAST(rv.qm AS DECIMAL(4,0)) * CAST({sentiment.QUESTION_STEP} AS DECIMAL(3,2))
                     ELSE CAST({sentiment.QUESTION_CAP} AS DECIMAL(3,2)) END AS {ACC}) AS punct
  FROM rv LEFT JOIN tsum ts ON rv.review_id = ts.review_id),
scored1 AS (
  SELECT review_id, product_id, rating,
         CAST(CASE WHEN total > 0 THEN total + punct WHEN total < 0 THEN total - punct
                   ELSE total END AS DOUBLE) AS s
  FROM scored0),
scored AS (
  SELECT review_id, product_id, rating,
         CAST(ROUND(CAST(greatest(-1.0, least(1.0, s / sqrt(s * s + {sentiment.ALPHA})))
                         AS DECIMAL(38,6)), 2) AS DECIMAL(5,2)) AS sentiment_score
  FROM scored1),
review_stats AS (
  SELECT product_id,
         {M("CAST(sum(sentiment_score) AS DOUBLE) / count(*)")} AS avg_sentiment,
         {M("avg(rating)")} AS avg_rating,
         count(*) AS review_count
  FROM scored WHERE product_id IS NOT NULL GROUP BY product_id),
catalogue AS (
  SELECT upper(p_name) AS competitor_product_name,
         CAST(ROUND(min(CAST(p_retailprice AS DECIMAL(12,2))) * CAST({S.COMPETITOR_FACTOR} AS DECIMAL(4,2)), 2)
              AS DOUBLE) AS competitor_price
  FROM part GROUP BY p_name),
cat_keys AS (
  SELECT trim(lower(regexp_replace(competitor_product_name, '[^\\p{{L}}\\p{{N}}]|_', ' ', 'g'))) AS k,
         min(competitor_product_name) AS matched_name
  FROM catalogue GROUP BY 1),
cat_price AS (
  SELECT lower(competitor_product_name) AS lname, min(competitor_price) AS competitor_price
  FROM catalogue GROUP BY 1),
matches AS (
  SELECT p.product_id, c.matched_name, 100 AS match_score, cp.competitor_price
  FROM products p
  JOIN cat_keys c
    ON trim(lower(regexp_replace(p.product_name, '[^\\p{{L}}\\p{{N}}]|_', ' ', 'g'))) = c.k
  LEFT JOIN cat_price cp ON lower(c.matched_name) = cp.lname
  WHERE p.product_name IS NOT NULL
    AND trim(lower(regexp_replace(p.product_name, '[^\\p{{L}}\\p{{N}}]|_', ' ', 'g'))) <> ''),
dim_product AS (
  SELECT p.product_id, p.product_name, p.subcategory_name, p.category_name, p.unit_price,
         p.unit_cost, m.competitor_price,
         {M("CAST(p.unit_price AS DOUBLE) - m.competitor_price")} AS price_difference,
         {M("CASE WHEN m.competitor_price = 0 THEN NULL ELSE (CAST(p.unit_price AS DOUBLE) - m.competitor_price) / m.competitor_price END * 100.0")} AS price_difference_pct,
         coalesce(rs.avg_sentiment, 0.0) AS avg_sentiment,
         coalesce(rs.avg_rating, 0.0) AS avg_rating,
         CAST(coalesce(rs.review_count, 0) AS BIGINT) AS review_count
  FROM products p
  LEFT JOIN review_stats rs ON p.product_id = rs.product_id
  LEFT JOIN matches m ON p.product_id = m.product_id),
store_target_totals AS (
  SELECT s_suppkey AS store_id, sum(CAST(s_acctbal AS DOUBLE)) AS target_revenue,
         min(replace(s_name, 'Supplier', 'Manager')) AS manager_name
  FROM supplier WHERE s_acctbal > 0 GROUP BY s_suppkey),
dim_store AS (
  SELECT s.s_suppkey AS store_id, s.s_name AS store_name, g.city_name, g.region,
         {M("t.target_revenue")} AS monthly_target,
         {M("t.target_revenue * 12")} AS annual_target,
         t.manager_name
  FROM supplier s LEFT JOIN geo g ON s.s_nationkey = g.nationkey
  LEFT JOIN store_target_totals t ON s.s_suppkey = t.store_id),
dim_customer AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, g.city_name, g.region
  FROM customer c LEFT JOIN geo g ON c.c_nationkey = g.nationkey),
ship AS (
  SELECT lower(trim(region_name)) AS ship_region,
         max(greatest(coalesce(TRY_CAST(trim(shipping_cost) AS DOUBLE), 0.0), 0.0)) AS shipping_rate
  FROM (SELECT DISTINCT * FROM {_SHIP}) GROUP BY 1),
sales AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number,
         CAST(o.o_orderdate AS DATE) AS full_date, l.l_partkey AS product_id,
         l.l_suppkey AS store_id, o.o_custkey AS customer_id,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              AS DECIMAL(18,4)) AS total_revenue
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
enriched AS (
  SELECT s.*, p.product_name, p.subcategory_name, p.category_name, p.unit_cost,
         p.avg_sentiment AS sentiment_score, p.competitor_price,
         c.customer_name, c.city_name AS customer_city, c.region AS customer_region,
         sh.shipping_rate,
         st.store_name, st.city_name AS store_city, st.region AS store_region,
         st.monthly_target, st.annual_target,
         lower(trim(p.category_name)) AS category,
         CAST(date_trunc('month', s.full_date) AS DATE) AS month_start,
         p.product_id IS NOT NULL AS _p, st.store_id IS NOT NULL AS _s,
         c.customer_id IS NOT NULL AS _c
  FROM sales s
  LEFT JOIN dim_product p ON s.product_id = p.product_id
  LEFT JOIN dim_customer c ON s.customer_id = c.customer_id
  LEFT JOIN ship sh ON lower(trim(c.region)) = sh.ship_region
  LEFT JOIN dim_store st ON s.store_id = st.store_id),
cm_totals AS (
  SELECT category, month_start, sum(total_revenue) AS cat_month_total
  FROM enriched WHERE category IS NOT NULL AND month_start IS NOT NULL
  GROUP BY category, month_start),
mkt AS (
  SELECT category, month_start,
         500 + ((year(month_start) * 12 + month(month_start)) * 37 + length(category) * 101 + campaign * 13) % 4000 AS usd
  FROM (SELECT category, month_start,
               unnest(range(1, 2 + (year(month_start) * 12 + month(month_start)) % 2)) AS campaign
        FROM (SELECT *, min(month_start) OVER (PARTITION BY category) AS first_month FROM cm_totals)
        WHERE month_start > first_month)),
spend AS (
  SELECT category, month_start,
         sum(CAST(ROUND(CAST(usd AS DECIMAL(18,2)) * CAST({clean.USD_TO_LOCAL} AS DECIMAL(12,4)), 2)
                  AS DECIMAL(18,2))) AS spend_local
  FROM mkt GROUP BY category, month_start),
cm AS (
  SELECT t.category, t.month_start, t.cat_month_total, sp.spend_local
  FROM cm_totals t LEFT JOIN spend sp
    ON t.category = sp.category AND t.month_start = sp.month_start),
alloc AS (
  SELECT e.*,
         coalesce(CAST(CAST(CASE WHEN CAST(cm.cat_month_total AS DOUBLE) = 0 THEN NULL
                             ELSE CAST(e.total_revenue AS DOUBLE) / CAST(cm.cat_month_total AS DOUBLE) END
                        * CAST(cm.spend_local AS DOUBLE) AS DECIMAL(38,6)) AS DECIMAL(18,4)),
                  CAST(0 AS DECIMAL(18,4))) AS marketing_cost
  FROM enriched e LEFT JOIN cm ON e.category = cm.category AND e.month_start = cm.month_start),
costs AS (
  SELECT *,
         coalesce(CAST(CAST(unit_cost AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(18,4)),
                  CAST(0 AS DECIMAL(18,4))) AS product_cost,
         coalesce(CAST(CAST(shipping_rate AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(18,4)),
                  CAST(0 AS DECIMAL(18,4))) AS shipping_cost
  FROM alloc),
fact AS (
  SELECT order_key, line_number,
         CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_id,
         CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter,
         CAST(month(full_date) AS INTEGER) AS month, monthname(full_date) AS month_name,
         CAST(day(full_date) AS INTEGER) AS day, CAST(isodow(full_date) - 1 AS INTEGER) AS day_of_week,
         dayname(full_date) AS day_name, CAST(weekofyear(full_date) AS INTEGER) AS week_of_year,
         full_date, month_start, product_id, store_id, customer_id, quantity, total_revenue,
         product_cost,
         CAST(total_revenue - product_cost AS DECIMAL(18,4)) AS gross_profit,
         shipping_cost, marketing_cost,
         CAST(ROUND(CAST(total_revenue - product_cost AS DECIMAL(18,4)) - shipping_cost - marketing_cost, 2)
              AS DECIMAL(18,4)) AS net_profit,
         category, product_name, subcategory_name, category_name, sentiment_score, competitor_price,
         store_name, store_city, store_region, monthly_target, annual_target,
         customer_name, customer_city, customer_region,
         coalesce(_p, FALSE) AND coalesce(_s, FALSE) AND full_date IS NOT NULL AS in_star,
         coalesce(_c, FALSE) AS customer_known
  FROM costs),
star AS (SELECT * FROM fact WHERE in_star),
star4 AS (SELECT * FROM star WHERE customer_known),
dim_date AS (
  SELECT DISTINCT date_id, full_date, year, quarter, month, month_name, day, day_of_week,
         day_name, week_of_year
  FROM fact WHERE full_date IS NOT NULL),
marketing_roi AS (
  SELECT category, strftime(month_start, '%Y-%m') AS month,
         {M("sum(total_revenue)")} AS total_revenue,
         {M("sum(marketing_cost)")} AS marketing_cost,
         CASE WHEN CAST(sum(marketing_cost) AS DOUBLE) <> 0
              THEN {M("(CAST(sum(total_revenue) AS DOUBLE) - CAST(sum(marketing_cost) AS DOUBLE)) * 100.0 / CAST(sum(marketing_cost) AS DOUBLE)")}
              WHEN CAST(sum(total_revenue) AS DOUBLE) <> 0 THEN 0.0 END AS roi_percent
  FROM fact WHERE category IS NOT NULL GROUP BY category, strftime(month_start, '%Y-%m'))
"""

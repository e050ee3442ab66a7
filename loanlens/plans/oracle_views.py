"""DuckDB SQL restatements of the fixture views, used only by the oracle.

Each constant is a list of CTE bodies (``name AS (...)``) that oracle queries
prefix with ``WITH``.  They are written independently of the Spark code in
``sources/fixtures.py`` so the oracle is a second implementation.
"""

PANEL = """
panel_src AS (
  SELECT l.*, l.l_suppkey % 25 AS s_nationkey,
         l_suppkey * 6
           + 2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END
           + CASE l_linestatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS loan_num
  FROM lineitem l
),
panel AS (
  SELECT
    CAST(loan_num AS VARCHAR) AS loan_id,
    CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS reporting_month,
    CAST(2.5 AS DOUBLE) + CAST(loan_num % 30 AS DOUBLE) * 0.125 AS original_interest_rate,
    CASE WHEN loan_num % 97 = 0 THEN CAST(0 AS DOUBLE)
         ELSE CAST(100000 + (loan_num % 50) * 1000 AS DOUBLE) END AS original_upb,
    CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS current_actual_upb,
    CAST(CASE WHEN loan_num % 4 = 0 THEN 180 ELSE 360 END AS INTEGER) AS original_loan_term,
    make_date(CAST(1995 + floor(((loan_num * 7) % 60) / 12) AS INTEGER),
              CAST(1 + ((loan_num * 7) % 60) % 12 AS INTEGER), 1) AS origination_date,
    CASE WHEN loan_num % 41 = 0 THEN NULL ELSE CAST(40 + loan_num % 60 AS DOUBLE) END AS original_ltv,
    CASE WHEN loan_num % 41 = 0 THEN NULL ELSE CAST(10 + loan_num % 50 AS DOUBLE) END AS original_dti,
    CASE WHEN loan_num % 41 = 0 THEN NULL ELSE CAST(600 + (loan_num * 13) % 251 AS DOUBLE) END
      AS borrower_credit_score,
    CASE loan_num % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'R' END AS loan_purpose,
    CASE l_returnflag WHEN 'A' THEN 'SF' WHEN 'N' THEN 'PU' ELSE 'CO' END AS property_type,
    CASE WHEN loan_num % 13 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 'P' ELSE 'I' END
      AS occupancy_status,
    n.n_name AS property_state,
    CAST(CASE WHEN l_quantity = 50 AND l_discount >= 0.05 THEN 3
              WHEN l_quantity >= 49 THEN 2 WHEN l_quantity >= 46 THEN 1 ELSE 0 END AS INTEGER)
      AS current_delinquency_status,
    CASE WHEN l_tax >= 0.08 THEN 'Y' ELSE 'N' END AS modification_flag,
    CAST(l_shipdate AS DATE) AS ingest_date,
    l_orderkey AS ingest_key,
    l_linenumber AS ingest_line
  FROM panel_src p LEFT JOIN nation n ON p.s_nationkey = n.n_nationkey
)"""

# SQL-mode snapshot over ``panel`` (6-month history, 12-month outcome): a table for each phase of a loan's life, the
# last values by row number, and the phases joined at the end.
SNAPSHOT = PANEL + """,
aged AS (
  SELECT *, 12 * year(reporting_month) + month(reporting_month)
            - 12 * year(origination_date) - month(origination_date) AS age
  FROM panel
  WHERE current_delinquency_status IS NOT NULL AND loan_id IS NOT NULL AND age BETWEEN 1 AND 18
),
early AS (
  SELECT loan_id, max(current_delinquency_status) AS worst, avg(current_actual_upb) AS mean_upb,
         stddev_samp(current_actual_upb) AS spread_upb,
         sum(CASE WHEN current_delinquency_status > 0 THEN 1 ELSE 0 END) AS late,
         sum(CASE WHEN modification_flag = 'Y' THEN 1 ELSE 0 END) AS modified
  FROM aged WHERE age < 7 GROUP BY loan_id HAVING count(*) > 5
),
late_phase AS (
  SELECT loan_id, bool_or(current_delinquency_status > 2) AS defaulted
  FROM aged WHERE age > 6 GROUP BY loan_id HAVING count(*) > 11
),
statics AS (
  SELECT loan_id, max(property_state) AS property_state, max(occupancy_status) AS occupancy_status,
         max(property_type) AS property_type, max(loan_purpose) AS loan_purpose,
         max(borrower_credit_score) AS borrower_credit_score, max(original_dti) AS original_dti,
         max(original_ltv) AS original_ltv, max(original_loan_term) AS original_loan_term,
         max(original_interest_rate) AS original_interest_rate, max(original_upb) AS original_upb,
         max(origination_date) AS origination_date
  FROM aged GROUP BY loan_id
),
balance AS (
  SELECT loan_id, current_actual_upb AS v FROM aged WHERE age < 7 AND current_actual_upb IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY reporting_month DESC, current_actual_upb DESC) = 1
),
standing AS (
  SELECT loan_id, current_delinquency_status AS v FROM aged WHERE age < 7
  QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY reporting_month DESC, current_delinquency_status DESC) = 1
),
snapshot AS (
  SELECT loan_id, s.origination_date, CAST(s.origination_date + INTERVAL 6 MONTH AS DATE) AS observation_date,
    s.original_upb, s.original_interest_rate, s.original_loan_term, s.original_ltv, s.original_dti,
    s.borrower_credit_score, s.loan_purpose, s.property_type, s.occupancy_status, s.property_state,
    e.worst AS hist_max_dpd, CAST(e.late AS BIGINT) AS hist_30dpd_months, e.mean_upb AS hist_avg_upb,
    e.spread_upb AS hist_upb_volatility, b.v AS hist_latest_upb, t.v AS hist_latest_dpd,
    CAST(e.modified AS BIGINT) AS hist_modified_months, CAST(l.defaulted AS INTEGER) AS bad_12m_90dpd,
    b.v / nullif(s.original_upb, 0) AS hist_upb_to_original_upb
  FROM late_phase l JOIN early e USING (loan_id) JOIN statics s USING (loan_id) JOIN standing t USING (loan_id)
    LEFT JOIN balance b USING (loan_id)
)"""

SCORED = """
scored AS (
  SELECT o_orderkey AS loan_id,
         CAST(o_orderdate AS DATE) AS observation_date,
         o_totalprice / 500000.0 AS pd,
         CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000.0 AS pd_b,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS bad,
         o_totalprice AS original_upb
  FROM orders
)"""

WIDE = """
ord_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders
),
ord6 AS (
  SELECT o_custkey,
    max(CASE WHEN rn = 1 THEN o_totalprice END) AS BILL_AMT1,
    max(CASE WHEN rn = 2 THEN o_totalprice END) AS BILL_AMT2,
    max(CASE WHEN rn = 3 THEN o_totalprice END) AS BILL_AMT3,
    max(CASE WHEN rn = 4 THEN o_totalprice END) AS BILL_AMT4,
    max(CASE WHEN rn = 5 THEN o_totalprice END) AS BILL_AMT5,
    max(CASE WHEN rn = 6 THEN o_totalprice END) AS BILL_AMT6,
    max(CASE WHEN rn = 1 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT1,
    max(CASE WHEN rn = 2 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT2,
    max(CASE WHEN rn = 3 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT3,
    max(CASE WHEN rn = 4 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT4,
    max(CASE WHEN rn = 5 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT5,
    max(CASE WHEN rn = 6 THEN o_totalprice * CAST(o_orderkey % 5 AS DOUBLE) / 10.0 END) AS PAY_AMT6,
    max(CASE WHEN rn = 1 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_0,
    max(CASE WHEN rn = 2 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_2,
    max(CASE WHEN rn = 3 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_3,
    max(CASE WHEN rn = 4 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_4,
    max(CASE WHEN rn = 5 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_5,
    max(CASE WHEN rn = 6 THEN CAST(o_orderkey % 11 - 2 AS INTEGER) END) AS PAY_6,
    max(CASE WHEN rn = 1 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS tgt
  FROM ord_ranked WHERE rn <= 6 GROUP BY o_custkey
),
wide AS (
  SELECT c_custkey AS ID, c_acctbal + 1000.0 AS LIMIT_BAL,
    CAST(c_custkey % 2 + 1 AS INTEGER) AS SEX, CAST(c_custkey % 7 AS INTEGER) AS EDUCATION,
    CAST(c_custkey % 4 AS INTEGER) AS MARRIAGE, CAST(c_custkey % 50 + 21 AS INTEGER) AS AGE,
    PAY_0, PAY_2, PAY_3, PAY_4, PAY_5, PAY_6,
    BILL_AMT1, BILL_AMT2, BILL_AMT3, BILL_AMT4, BILL_AMT5, BILL_AMT6,
    PAY_AMT1, PAY_AMT2, PAY_AMT3, PAY_AMT4, PAY_AMT5, PAY_AMT6,
    CAST(coalesce(tgt, 0) AS INTEGER) AS default_payment_next_month
  FROM customer LEFT JOIN ord6 ON c_custkey = o_custkey
)"""

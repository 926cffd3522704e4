-- view raw_application
SELECT c_custkey AS SK_ID_CURR,
       CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS CODE_GENDER,
       c_mktsegment AS NAME_INCOME_TYPE,
       'EDU_' || (c_nationkey % 5) AS NAME_EDUCATION_TYPE,
       'HOUSE_' || (c_nationkey % 3) AS NAME_HOUSING_TYPE,
       'Cash loans' AS NAME_CONTRACT_TYPE,
       CAST(-(7000 + c_custkey * 37 % 18000) AS INTEGER) AS DAYS_BIRTH,
       CAST(-(c_custkey * 13 % 9000) AS INTEGER) AS DAYS_REGISTRATION,
       CASE WHEN c_custkey % 50 <> 0 THEN 20000 + 10 * abs(c_acctbal) END AS AMT_INCOME_TOTAL,
       5 * abs(c_acctbal) AS AMT_CREDIT,
       CASE WHEN c_nationkey < 20 THEN 't0' ELSE 't1' END AS TENANT
FROM customer WHERE c_custkey % 20 <> 19

-- view raw_previous
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR, o_orderpriority AS NAME_CONTRACT_TYPE,
       CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Completed' ELSE 'Refused' END
           AS NAME_CONTRACT_STATUS,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS AMT_CREDIT,
       o_totalprice AS AMT_APPLICATION,
       CAST(CAST(o_orderdate AS DATE) - DATE '2024-02-01' AS INTEGER) AS DAYS_DECISION,
       CAST(CAST(o_orderdate AS DATE) - DATE '2024-02-01' AS INTEGER) + 360 AS DAYS_LAST_DUE
FROM orders WHERE o_orderkey % 3 <> 0

-- view raw_bureau
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR, o_orderpriority AS CREDIT_TYPE,
       CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'Active' ELSE 'Inactive' END AS CREDIT_ACTIVE,
       o_totalprice AS AMT_CREDIT_SUM,
       CAST(CAST(o_orderdate AS DATE) - DATE '2024-02-01' AS INTEGER) AS DAYS_CREDIT,
       CASE WHEN o_orderkey % 5 <> 0
            THEN CAST(CAST(o_orderdate AS DATE) - DATE '2024-02-01' AS INTEGER) + 720 END AS DAYS_CREDIT_ENDDATE,
       CAST(CASE WHEN o_orderkey % 12 = 0 THEN o_orderkey % 40 ELSE 0 END AS INTEGER) AS CREDIT_DAY_OVERDUE
FROM orders WHERE o_orderkey % 3 = 0

-- view raw_installments
SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
       1 AS NUM_INSTALMENT_VERSION, l_linenumber AS NUM_INSTALMENT_NUMBER,
       l_extendedprice AS AMT_INSTALMENT,
       CAST((CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)
             * (100 - CAST(round_even(l_discount * 100, 0) AS BIGINT)) + 50) // 100 AS DOUBLE) / 100 AS AMT_PAYMENT,
       CAST(CAST(l_shipdate AS DATE) - DATE '2024-02-01' AS INTEGER) AS DAYS_INSTALMENT,
       CAST(trunc(CAST(CAST(l_shipdate AS DATE) - DATE '2024-02-01' AS INTEGER) + l_quantity - 45) AS INTEGER)
           AS DAYS_ENTRY_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey

-- view raw_card
SELECT user_id * 10 + event_id % 2 AS SK_ID_PREV, user_id AS SK_ID_CURR,
       CAST(-(event_id % 96) AS INTEGER) AS MONTHS_BALANCE,
       CASE WHEN event_type = 'error' THEN -value ELSE value END AS AMT_BALANCE,
       CASE WHEN event_type = 'signup' THEN 0.0 ELSE 500.0 END::DOUBLE AS AMT_CREDIT_LIMIT_ACTUAL,
       CAST(CASE WHEN event_type = 'error' THEN event_id % 45 ELSE 0 END AS INTEGER) AS SK_DPD
FROM events WHERE event_id % 3 = 0

-- view raw_pos
SELECT user_id * 10 + event_id % 2 AS SK_ID_PREV, user_id AS SK_ID_CURR,
       CAST(-(event_id % 96) AS INTEGER) AS MONTHS_BALANCE,
       CAST(CASE WHEN event_type = 'error' THEN event_id % 45 ELSE 0 END AS INTEGER) AS SK_DPD
FROM events WHERE event_id % 3 = 1

-- view raw_bureau_balance
SELECT event_id * 3 AS SK_ID_BUREAU, CAST(-(event_id % 96) AS INTEGER) AS MONTHS_BALANCE,
       CASE event_id % 8 WHEN 6 THEN 'C' WHEN 7 THEN 'X' ELSE CAST(event_id % 8 AS VARCHAR) END AS STATUS
FROM events WHERE event_id % 3 = 2

-- view raw_bureau_owned
SELECT b.SK_ID_BUREAU, b.MONTHS_BALANCE, b.STATUS, o.SK_ID_CURR
FROM raw_bureau_balance b LEFT JOIN raw_bureau o ON b.SK_ID_BUREAU = o.SK_ID_BUREAU

-- view raw_events
SELECT 'SIM::' || event_id AS transaction_id, user_id AS customer_id,
       CASE WHEN event_type IN ('purchase', 'click') THEN 'LOAN_PAYMENT' ELSE 'BALANCE_SNAPSHOT' END
           AS transaction_type,
       value AS amount,
       CASE WHEN event_type <> 'view' THEN 100.0 END::DOUBLE AS expected_amount,
       CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) - 50 ELSE 0 END
           AS days_past_due,
       CASE WHEN event_id % 11 = 0 THEN 'bogus' WHEN event_id % 13 = 0 THEN 'late' END AS status,
       CASE WHEN event_id % 7 = 0 THEN 'CC_' || (user_id * 10) END AS reference_id,
       CAST(ts AS DATE) AS transaction_date,
       event_id, event_type, ts AS event_time
FROM events

-- view score_points
SELECT o_orderkey AS history_id, o_custkey AS customer_id, (o_orderkey * 7919 % 1000 + 1) / 2000 AS p,
       CASE WHEN o_orderkey % 17 <> 0
            THEN o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) END AS score_generated_at
FROM orders WHERE o_custkey % 4 <> 0

-- view score_history
SELECT history_id, customer_id,
       CAST(greatest(300, least(850, round_even(600 - 20 / ln(2.0) * ln(11.650360581192938::DOUBLE)
           + 20 / ln(2.0) * ln((1 - p) / p), 0))) AS INTEGER) AS credit_score,
       p AS default_probability,
       CASE WHEN p <= 0.05 THEN 'LOW' WHEN p <= 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
       score_generated_at, 'SIMULATION' AS source
FROM score_points

-- view silver_customers
SELECT * FROM (
  SELECT SK_ID_CURR AS customer_id, TENANT AS institution_id, 'home_credit' AS source_system,
         CODE_GENDER AS gender, CAST(floor(abs(DAYS_BIRTH) / 365.25::DOUBLE) AS INTEGER) AS age,
         AMT_INCOME_TOTAL AS income, NAME_INCOME_TYPE AS employment_type, NAME_EDUCATION_TYPE AS education,
         NAME_HOUSING_TYPE AS housing_type, DATE '2024-02-01' + DAYS_REGISTRATION AS account_open_date,
         'application_train' AS record_source
  FROM raw_application)
QUALIFY row_number() OVER (PARTITION BY customer_id, institution_id
    ORDER BY gender NULLS FIRST, age NULLS FIRST, income NULLS FIRST) = 1

-- view loan_rows
SELECT 'APP_' || SK_ID_CURR AS loan_id, SK_ID_CURR AS customer_id, NAME_CONTRACT_TYPE AS loan_type,
       AMT_CREDIT AS loan_amount, 'APPLICATION' AS loan_status,
       DATE '2024-02-01' + DAYS_REGISTRATION AS start_date, CAST(NULL AS DATE) AS end_date,
       0 AS days_past_due, TARGET AS default_flag
FROM raw_application
UNION ALL
SELECT 'PREV_' || SK_ID_PREV, SK_ID_CURR, NAME_CONTRACT_TYPE, coalesce(AMT_CREDIT, AMT_APPLICATION),
       NAME_CONTRACT_STATUS, DATE '2024-02-01' + DAYS_DECISION, DATE '2024-02-01' + DAYS_LAST_DUE, 0, 0
FROM raw_previous
UNION ALL
SELECT 'BUR_' || SK_ID_BUREAU, SK_ID_CURR, CREDIT_TYPE, AMT_CREDIT_SUM, CREDIT_ACTIVE,
       DATE '2024-02-01' + DAYS_CREDIT, DATE '2024-02-01' + DAYS_CREDIT_ENDDATE,
       CREDIT_DAY_OVERDUE, CASE WHEN CREDIT_DAY_OVERDUE > 0 THEN 1 ELSE 0 END
FROM raw_bureau

-- view silver_loans
SELECT loan_id, customer_id, 't0' AS institution_id, 'home_credit' AS source_system, loan_type, loan_amount,
       loan_status, start_date, end_date, days_past_due, default_flag
FROM loan_rows
QUALIFY row_number() OVER (PARTITION BY loan_id ORDER BY customer_id NULLS FIRST, loan_type NULLS FIRST,
    loan_amount NULLS FIRST, loan_status NULLS FIRST, start_date NULLS FIRST) = 1

-- view payment_rows
SELECT concat_ws('_', 'PAY', SK_ID_PREV, NUM_INSTALMENT_VERSION, NUM_INSTALMENT_NUMBER) AS payment_id,
       'PREV_' || SK_ID_PREV AS loan_id, SK_ID_CURR AS customer_id, AMT_PAYMENT AS payment_amount,
       AMT_INSTALMENT AS scheduled_amount, DATE '2024-02-01' + DAYS_ENTRY_PAYMENT AS payment_date,
       greatest(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT, 0) AS days_late
FROM raw_installments

-- view silver_payments
SELECT payment_id, loan_id, customer_id, 't0' AS institution_id, 'home_credit' AS source_system,
       payment_amount, scheduled_amount, payment_date, days_late
FROM payment_rows
QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY loan_id, customer_id NULLS FIRST,
    payment_amount NULLS FIRST, scheduled_amount NULLS FIRST, payment_date NULLS FIRST, days_late NULLS FIRST) = 1

-- view balance_rows
SELECT 'CC_' || SK_ID_PREV AS account_id, SK_ID_CURR AS customer_id, AMT_BALANCE AS balance,
       AMT_CREDIT_LIMIT_ACTUAL AS credit_limit, SK_DPD AS days_past_due,
       CAST(DATE '2024-02-01' + to_months(MONTHS_BALANCE) AS DATE) AS snapshot_date
FROM raw_card
UNION ALL
SELECT 'POS_' || SK_ID_PREV, SK_ID_CURR, NULL, NULL, SK_DPD,
       CAST(DATE '2024-02-01' + to_months(MONTHS_BALANCE) AS DATE)
FROM raw_pos
UNION ALL
SELECT 'BUR_' || SK_ID_BUREAU, SK_ID_CURR, NULL, NULL,
       CASE WHEN regexp_matches(STATUS, '^[0-5]$') THEN CAST(STATUS AS INTEGER) ELSE 0 END,
       CAST(DATE '2024-02-01' + to_months(MONTHS_BALANCE) AS DATE)
FROM raw_bureau_owned WHERE SK_ID_CURR IS NOT NULL

-- view silver_balances
SELECT account_id, customer_id, 't0' AS institution_id, 'home_credit' AS source_system, balance, credit_limit,
       days_past_due, snapshot_date
FROM balance_rows
WHERE coalesce(abs(balance), 0) > 0 OR coalesce(abs(credit_limit), 0) > 0 OR days_past_due > 0
QUALIFY row_number() OVER (PARTITION BY account_id, snapshot_date ORDER BY customer_id NULLS FIRST,
    balance NULLS FIRST, credit_limit NULLS FIRST, days_past_due NULLS FIRST) = 1

-- view silver_transactions
SELECT payment_id AS transaction_id, customer_id, institution_id, source_system,
       'LOAN_PAYMENT' AS transaction_type, payment_date AS transaction_date, payment_amount AS amount,
       scheduled_amount AS expected_amount, payment_amount - scheduled_amount AS delta_amount,
       CASE WHEN days_late > 0 THEN 'LATE' ELSE 'ON_TIME' END AS status, loan_id AS reference_id,
       days_late AS days_past_due
FROM silver_payments
UNION ALL
SELECT 'BAL::' || account_id || '::' || snapshot_date, customer_id, institution_id, source_system,
       'BALANCE_SNAPSHOT', snapshot_date, balance, credit_limit, NULL,
       CASE WHEN days_past_due > 0 THEN 'PAST_DUE' ELSE 'CURRENT' END, account_id, days_past_due
FROM silver_balances

-- view loan_agg
SELECT customer_id, count(DISTINCT loan_id) AS total_loans,
       CAST(sum(CASE WHEN regexp_matches(upper(coalesce(loan_status, '')), 'ACTIVE|APPROVED')
                     THEN 1 ELSE 0 END) AS BIGINT) AS active_loans,
       CAST(sum(CASE WHEN regexp_matches(upper(coalesce(loan_status, '')), 'CLOSED|COMPLETED')
                     THEN 1 ELSE 0 END) AS BIGINT) AS closed_loans,
       max(days_past_due) AS loan_max_days_past_due, avg(days_past_due) AS loan_avg_days_past_due,
       CAST(sum(CAST(CASE WHEN regexp_matches(upper(coalesce(loan_status, '')), 'ACTIVE|APPROVED')
                          THEN loan_amount ELSE 0 END AS DECIMAL(38, 8))) AS DOUBLE) AS active_loan_debt,
       max(default_flag) AS default_flag
FROM silver_loans GROUP BY customer_id

-- view payment_agg
SELECT customer_id, count(DISTINCT transaction_id) AS total_payments,
       CAST(sum(CASE WHEN coalesce(days_past_due, 0) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS late_payments
FROM silver_transactions WHERE transaction_type = 'LOAN_PAYMENT' GROUP BY customer_id

-- view balance_agg
SELECT customer_id, count(DISTINCT reference_id) AS total_accounts,
       CAST(DATE '2024-02-01' - min(transaction_date) AS INTEGER) AS account_age_days,
       CAST(sum(CAST(amount AS DECIMAL(38, 8))) AS DOUBLE) / count(amount) AS avg_balance,
       max(amount) AS max_balance, min(amount) AS min_balance,
       CAST(sum(CAST(expected_amount AS DECIMAL(38, 8))) AS DOUBLE) / count(expected_amount) AS avg_credit_limit,
       stddev_samp(amount) AS account_stability,
       max(days_past_due) AS account_max_days_past_due, avg(days_past_due) AS account_avg_days_past_due,
       CAST(sum(CAST(CASE WHEN amount > 0 THEN amount ELSE 0 END AS DECIMAL(38, 8))) AS DOUBLE)
           AS account_positive_balance
FROM silver_transactions WHERE transaction_type = 'BALANCE_SNAPSHOT' GROUP BY customer_id

-- view customer_meta
SELECT customer_id,
       CASE WHEN count(DISTINCT institution_id) > 1 THEN 'multi' ELSE min(institution_id) END AS institution_id,
       CASE WHEN count(DISTINCT source_system) > 1 THEN 'multi' ELSE min(source_system) END AS source_system,
       max(income) AS income
FROM silver_customers GROUP BY customer_id

-- view customer_universe
SELECT customer_id FROM silver_customers WHERE customer_id IS NOT NULL
UNION SELECT customer_id FROM silver_loans WHERE customer_id IS NOT NULL
UNION SELECT customer_id FROM silver_transactions WHERE customer_id IS NOT NULL

-- view gold_features
SELECT u.customer_id, coalesce(m.institution_id, 'unknown') AS institution_id,
       coalesce(m.source_system, 'unknown') AS source_system,
       CAST(coalesce(b.total_accounts, 0) AS INTEGER) AS total_accounts,
       coalesce(b.account_age_days, 0) AS account_age_days,
       coalesce(b.avg_balance, 0) AS avg_balance, coalesce(b.max_balance, 0) AS max_balance,
       coalesce(b.min_balance, 0) AS min_balance,
       CAST(coalesce(l.total_loans, 0) AS INTEGER) AS total_loans,
       CAST(coalesce(l.active_loans, 0) AS INTEGER) AS active_loans,
       CAST(coalesce(l.closed_loans, 0) AS INTEGER) AS closed_loans,
       CAST(coalesce(p.total_payments, 0) AS INTEGER) AS total_payments,
       CAST(coalesce(p.late_payments, 0) AS INTEGER) AS late_payments,
       coalesce(CAST(p.late_payments AS DOUBLE) / nullif(p.total_payments, 0), 0) AS late_payment_ratio,
       coalesce(greatest(l.loan_max_days_past_due, b.account_max_days_past_due), 0) AS max_days_past_due,
       (coalesce(l.loan_avg_days_past_due, 0) + coalesce(b.account_avg_days_past_due, 0))
           / CASE WHEN l.loan_avg_days_past_due IS NOT NULL AND b.account_avg_days_past_due IS NOT NULL
                  THEN 2 ELSE 1 END AS avg_days_past_due,
       coalesce(l.active_loan_debt, 0) + coalesce(b.account_positive_balance, 0) AS total_debt,
       coalesce((coalesce(l.active_loan_debt, 0) + coalesce(b.account_positive_balance, 0))
           / nullif(m.income, 0), 0) AS debt_to_income_ratio,
       coalesce(b.avg_balance / nullif(b.avg_credit_limit, 0), 0) AS credit_utilization,
       coalesce(b.account_stability, 0) AS account_stability,
       coalesce(l.default_flag, 0) AS default_flag
FROM customer_universe u
LEFT JOIN customer_meta m ON m.customer_id = u.customer_id
LEFT JOIN loan_agg l ON l.customer_id = u.customer_id
LEFT JOIN payment_agg p ON p.customer_id = u.customer_id
LEFT JOIN balance_agg b ON b.customer_id = u.customer_id

-- view model_logit
SELECT *, -0.5::DOUBLE + -0.05::DOUBLE * total_accounts + -0.0002::DOUBLE * account_age_days
          + 0.04::DOUBLE * active_loans + 3.0::DOUBLE * late_payment_ratio
          + 0.02::DOUBLE * max_days_past_due + 0.01::DOUBLE * debt_to_income_ratio
          + 0.4::DOUBLE * credit_utilization AS z
FROM gold_features

-- view model_raw
SELECT customer_id, institution_id, source_system, default_flag,
       CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS raw_p
FROM model_logit

-- view model_calibrated
SELECT *, greatest(1e-6, least(1 - 1e-6,
           CASE WHEN y >= 0 THEN 1 / (1 + exp(-y)) ELSE exp(y) / (1 + exp(y)) END)) AS p
FROM (SELECT *, -2.3946103913682166::DOUBLE + 1.1236752427476158::DOUBLE
             * ln(greatest(1e-6, least(1 - 1e-6, raw_p)) / (1 - greatest(1e-6, least(1 - 1e-6, raw_p)))) AS y
      FROM model_raw)

-- view current_scores
SELECT customer_id, institution_id, source_system,
       CAST(greatest(300, least(850, round_even(600 - 20 / ln(2.0) * ln(11.650360581192938::DOUBLE)
           + 20 / ln(2.0) * ln((1 - p) / p), 0))) AS INTEGER) AS credit_score,
       p AS default_probability,
       CASE WHEN p <= 0.05 THEN 'LOW' WHEN p <= 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level,
       TIMESTAMP '2024-02-01' AS score_generated_at
FROM model_calibrated

-- view profile
SELECT customer_id, institution_id, source_system, gender, age, income, employment_type, education, housing_type,
       account_open_date
FROM silver_customers
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY institution_id) = 1

-- view history_newest
SELECT * FROM score_history
QUALIFY row_number() OVER (PARTITION BY customer_id
    ORDER BY score_generated_at DESC NULLS LAST, history_id DESC) <= 12

-- view history_points
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id
           ORDER BY score_generated_at ASC NULLS FIRST, history_id) AS INTEGER) AS point,
       credit_score, risk_level, default_probability, score_generated_at
FROM history_newest
UNION ALL
SELECT customer_id, 1, credit_score, risk_level, default_probability, score_generated_at
FROM current_scores WHERE customer_id NOT IN (SELECT customer_id FROM score_history)

-- view history_labelled
SELECT h.*, strftime(coalesce(h.score_generated_at, s.score_generated_at, TIMESTAMP '2024-02-01'), '%Y-%m')
           AS period
FROM history_points h LEFT JOIN current_scores s ON s.customer_id = h.customer_id

-- view history_ends
SELECT customer_id, count(*) AS points, max_by(credit_score, point) - min_by(credit_score, point) AS change
FROM history_points GROUP BY customer_id

-- view recent
SELECT transaction_id, customer_id, transaction_type, transaction_date, amount, expected_amount, delta_amount,
       status, reference_id, days_past_due,
       CAST(row_number() OVER (PARTITION BY customer_id
           ORDER BY transaction_date DESC NULLS LAST, transaction_id DESC) AS INTEGER) AS rank
FROM silver_transactions

-- view recent_summary
SELECT customer_id, count(*) AS total_transactions, max(transaction_date) AS latest_transaction_date,
       round(CAST(sum(CAST(CASE WHEN transaction_type = 'LOAN_PAYMENT' THEN coalesce(amount, 0) ELSE 0 END
           AS DECIMAL(38, 8))) AS DOUBLE), 2) AS total_payment_amount,
       count(*) FILTER (WHERE upper(status) IN ('LATE', 'PAST_DUE')) AS late_or_past_due_events
FROM recent GROUP BY customer_id

-- view rule_inputs
SELECT customer_id, debt_to_income_ratio AS dti, late_payment_ratio AS late, credit_utilization AS used,
       max_days_past_due AS overdue, account_age_days AS age, active_loans AS open_loans, total_accounts AS accounts
FROM gold_features

-- view factor_hits
SELECT customer_id, 1 AS rule, 'Debt-to-income ratio' AS factor, 'negative' AS impact, dti - 0.40 AS weight,
       CAST(printf('%.2f', dti) AS DOUBLE) AS value, '<= 0.35' AS benchmark FROM rule_inputs WHERE dti > 0.40
UNION ALL SELECT customer_id, 2, 'Debt-to-income ratio', 'positive', 0.35 - dti,
       CAST(printf('%.2f', dti) AS DOUBLE), '<= 0.35' FROM rule_inputs WHERE dti <= 0.25
UNION ALL SELECT customer_id, 3, 'Late payment ratio', 'negative', late - 0.08,
       CAST(printf('%.2f', late) AS DOUBLE), '<= 0.05' FROM rule_inputs WHERE late > 0.08
UNION ALL SELECT customer_id, 4, 'Late payment ratio', 'positive', 0.05 - late,
       CAST(printf('%.2f', late) AS DOUBLE), '<= 0.05' FROM rule_inputs WHERE late <= 0.02
UNION ALL SELECT customer_id, 5, 'Credit utilization', 'negative', used - 0.65,
       CAST(printf('%.2f', used) AS DOUBLE), '<= 0.30' FROM rule_inputs WHERE used > 0.65
UNION ALL SELECT customer_id, 6, 'Credit utilization', 'positive', 0.30 - used,
       CAST(printf('%.2f', used) AS DOUBLE), '<= 0.30' FROM rule_inputs WHERE used BETWEEN 0 AND 0.30
UNION ALL SELECT customer_id, 7, 'Maximum days past due', 'negative', overdue - 30, overdue, '<= 7 days'
FROM rule_inputs WHERE overdue > 30
UNION ALL SELECT customer_id, 8, 'Maximum days past due', 'positive', 7, overdue, '<= 7 days'
FROM rule_inputs WHERE overdue = 0
UNION ALL SELECT customer_id, 9, 'Account age', 'negative', (365 - age) / 365::DOUBLE, age, '>= 365 days'
FROM rule_inputs WHERE age < 365
UNION ALL SELECT customer_id, 10, 'Account age', 'positive', age / 365::DOUBLE, age, '>= 365 days'
FROM rule_inputs WHERE age >= 1095
UNION ALL SELECT customer_id, 11, 'Active loans', 'negative', open_loans - 5, open_loans, '<= 5'
FROM rule_inputs WHERE open_loans > 5
UNION ALL SELECT customer_id, 12, 'Account depth', 'positive', accounts - 3, accounts, '>= 3 accounts'
FROM rule_inputs WHERE accounts >= 4 AND age >= 365

-- view factors
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id
           ORDER BY impact = 'positive', weight DESC, rule) AS INTEGER) AS rank, factor, impact, value, benchmark
FROM factor_hits QUALIFY rank <= 6

-- view base_hits
SELECT customer_id, 1 AS rule, 'Lower debt-to-income ratio' AS title, 'high' AS priority
FROM rule_inputs WHERE dti > 0.40
UNION ALL SELECT customer_id, 2, 'Improve payment consistency', 'high' FROM rule_inputs
WHERE late > 0.05 OR overdue > 7
UNION ALL SELECT customer_id, 3, 'Reduce credit utilization', 'medium' FROM rule_inputs WHERE used > 0.50
UNION ALL SELECT customer_id, 4, 'Consolidate active obligations', 'medium' FROM rule_inputs WHERE open_loans > 5
UNION ALL SELECT customer_id, 5, 'Build account tenure', 'low' FROM rule_inputs WHERE age < 365
UNION ALL SELECT customer_id, 6, 'Maintain strong profile', 'low' FROM rule_inputs
WHERE NOT (dti > 0.40 OR late > 0.05 OR overdue > 7 OR used > 0.50 OR open_loans > 5 OR age < 365)

-- view base_ranked
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rule) AS INTEGER) AS rank,
       title, priority FROM base_hits

-- view plan_inputs
SELECT i.*, coalesce(e.points, 0) AS points, coalesce(e.change, 0) AS change,
       coalesce(s.late_or_past_due_events, 0) AS negative_events
FROM rule_inputs i LEFT JOIN history_ends e ON e.customer_id = i.customer_id
LEFT JOIN recent_summary s ON s.customer_id = i.customer_id

-- view plan_hits
SELECT customer_id, 1 AS rule, 'Stop score decline first' AS title, 'high' AS priority FROM plan_inputs
WHERE points >= 2 AND change <= -25
UNION ALL SELECT customer_id, 2, 'Protect the positive momentum', 'low' FROM plan_inputs
WHERE points >= 2 AND change >= 20
UNION ALL SELECT customer_id, 3, 'Address recurring negative transactions', 'high' FROM plan_inputs
WHERE negative_events >= 3
UNION ALL SELECT customer_id, 4, 'Reduce debt burden over 60 days', 'high' FROM plan_inputs WHERE dti > 0.40
UNION ALL SELECT customer_id, 5, 'Lower revolving utilization', 'medium' FROM plan_inputs WHERE used > 0.50
UNION ALL SELECT customer_id, 6, 'Eliminate late payments in next 90 days', 'high' FROM plan_inputs WHERE late > 0.05
UNION ALL SELECT customer_id, 100 + rule, title, priority FROM base_hits

-- view plan
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY rule) AS INTEGER) AS rank,
       title, priority
FROM (SELECT * FROM plan_hits
      QUALIFY row_number() OVER (PARTITION BY customer_id, lower(trim(title)) ORDER BY rule) = 1)
QUALIFY rank <= 6

-- view snapshot
SELECT s.customer_id, s.credit_score, s.risk_level, s.default_probability, f.account_age_days, f.total_payments,
       f.late_payments, f.max_days_past_due, f.late_payment_ratio, f.debt_to_income_ratio, f.credit_utilization,
       f.account_stability, f.total_debt
FROM current_scores s JOIN gold_features f ON f.customer_id = s.customer_id

-- view trend_times
SELECT *, coalesce(score_generated_at, CAST(period || '-01' AS TIMESTAMP)) AS time FROM history_labelled

-- view trend_units
SELECT customer_id,
       CASE WHEN count(DISTINCT date_trunc('year', time)) > 1 THEN 'year'
            WHEN count(DISTINCT date_trunc('month', time)) > 1 THEN 'month'
            WHEN count(DISTINCT date_trunc('day', time)) > 1 THEN 'day' ELSE 'time' END AS granularity
FROM trend_times GROUP BY customer_id

-- view trend
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY bucket) AS INTEGER) AS place,
       granularity, bucket, credit_score
FROM (SELECT t.customer_id, u.granularity, t.credit_score, t.time, t.point,
             CASE u.granularity WHEN 'year' THEN date_trunc('year', t.time) WHEN 'month' THEN date_trunc('month', t.time)
                  WHEN 'day' THEN date_trunc('day', t.time) ELSE date_trunc('minute', t.time) END AS bucket
      FROM trend_times t JOIN trend_units u ON u.customer_id = t.customer_id
      QUALIFY row_number() OVER (PARTITION BY t.customer_id, bucket ORDER BY t.time DESC, t.point DESC) = 1)

-- view labelled
SELECT *, CASE WHEN upper(status) IN ('LATE', 'PAST_DUE') THEN 'Late payment'
               WHEN transaction_type = 'LOAN_PAYMENT' THEN 'On-time payment'
               WHEN coalesce(expected_amount, 0) > 0 AND coalesce(amount, 0) / expected_amount < 0.3
                   THEN 'Credit utilization reduced'
               ELSE 'Balance updated' END AS activity,
       CASE WHEN upper(status) IN ('LATE', 'PAST_DUE') THEN 'negative'
            WHEN transaction_type = 'LOAN_PAYMENT' THEN 'positive'
            WHEN coalesce(expected_amount, 0) > 0 AND coalesce(amount, 0) / expected_amount < 0.3 THEN 'positive'
            ELSE 'neutral' END AS tone
FROM silver_transactions

-- view online_rows
SELECT customer_id, transaction_id, transaction_type, transaction_date, coalesce(amount, 0) AS amount,
       CASE WHEN expected_amount > 0 THEN expected_amount END AS credit_limit, reference_id,
       coalesce(days_past_due, 0) AS days_past_due
FROM silver_transactions

-- view online_loans
SELECT customer_id, count(DISTINCT loan_id) AS total_loans,
       count(*) FILTER (WHERE regexp_matches(upper(coalesce(loan_status, '')), 'ACTIVE|APPROVED')) AS active_loans,
       count(*) FILTER (WHERE regexp_matches(upper(coalesce(loan_status, '')), 'CLOSED|COMPLETED')) AS closed_loans,
       max(coalesce(days_past_due, 0)) AS overdue_max, avg(coalesce(days_past_due, 0)) AS overdue_avg,
       CAST(sum(CAST(CASE WHEN regexp_matches(upper(coalesce(loan_status, '')), 'ACTIVE|APPROVED')
                          THEN coalesce(loan_amount, 0) ELSE 0 END AS DECIMAL(38, 8))) AS DOUBLE) AS debt
FROM silver_loans GROUP BY customer_id

-- view online_tenants
SELECT customer_id,
       CASE WHEN count(DISTINCT institution_id) > 1 THEN 'multi' ELSE min(institution_id) END AS institution_id,
       CASE WHEN count(DISTINCT source_system) > 1 THEN 'multi' ELSE min(source_system) END AS source_system
FROM (SELECT customer_id, institution_id, source_system FROM profile
      UNION ALL SELECT customer_id, institution_id, source_system FROM silver_loans
      UNION ALL SELECT customer_id, institution_id, source_system FROM silver_transactions)
GROUP BY customer_id

-- view online_activity
SELECT customer_id, count(DISTINCT transaction_id) FILTER (WHERE transaction_type = 'LOAN_PAYMENT') AS total_payments,
       count(*) FILTER (WHERE transaction_type = 'LOAN_PAYMENT' AND days_past_due > 0) AS late_payments,
       count(DISTINCT reference_id) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS total_accounts,
       min(transaction_date) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS first_snapshot,
       count(*) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS balances,
       CAST(sum(CAST(amount AS DECIMAL(38, 8))) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS DOUBLE)
           AS balance_total,
       max(amount) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS max_balance,
       min(amount) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS min_balance,
       stddev_samp(amount) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS spread,
       count(credit_limit) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS limits,
       CAST(sum(CAST(credit_limit AS DECIMAL(38, 8))) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS DOUBLE)
           AS limit_total,
       max(days_past_due) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS overdue_max,
       avg(days_past_due) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS overdue_avg,
       CAST(sum(CAST(greatest(amount, 0) AS DECIMAL(38, 8)))
           FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS DOUBLE) AS positive_total
FROM online_rows GROUP BY customer_id

-- view online_inputs
SELECT p.customer_id, t.institution_id, t.source_system, p.income, DATE '2024-02-01' AS as_of,
       coalesce(l.total_loans, 0) AS total_loans, coalesce(l.active_loans, 0) AS active_loans,
       coalesce(l.closed_loans, 0) AS closed_loans, l.overdue_max AS loan_overdue_max,
       l.overdue_avg AS loan_overdue_avg, coalesce(l.debt, 0) AS loan_debt,
       a.total_payments, a.late_payments, a.total_accounts, a.first_snapshot, a.balances, a.balance_total,
       a.max_balance, a.min_balance, a.spread, a.limits, a.limit_total, a.overdue_max, a.overdue_avg, a.positive_total
FROM profile p LEFT JOIN online_tenants t ON t.customer_id = p.customer_id
LEFT JOIN online_loans l ON l.customer_id = p.customer_id
LEFT JOIN online_activity a ON a.customer_id = p.customer_id

-- view online_features
SELECT customer_id, coalesce(institution_id, 'unknown') AS institution_id,
       coalesce(source_system, 'unknown') AS source_system,
       CAST(coalesce(total_accounts, 0) AS INTEGER) AS total_accounts,
       CAST(greatest(coalesce(as_of - first_snapshot, 0), 0) AS INTEGER) AS account_age_days,
       coalesce(balance_total / nullif(balances, 0), 0) AS avg_balance, coalesce(max_balance, 0) AS max_balance,
       coalesce(min_balance, 0) AS min_balance, CAST(total_loans AS INTEGER) AS total_loans,
       CAST(active_loans AS INTEGER) AS active_loans, CAST(closed_loans AS INTEGER) AS closed_loans,
       CAST(coalesce(total_payments, 0) AS INTEGER) AS total_payments,
       CAST(coalesce(late_payments, 0) AS INTEGER) AS late_payments,
       coalesce(late_payments::DOUBLE / nullif(total_payments, 0), 0) AS late_payment_ratio,
       coalesce(greatest(loan_overdue_max, overdue_max), 0) AS max_days_past_due,
       (coalesce(loan_overdue_avg, 0) + coalesce(overdue_avg, 0))
           / CASE WHEN loan_overdue_avg IS NOT NULL AND overdue_avg IS NOT NULL THEN 2 ELSE 1 END AS avg_days_past_due,
       loan_debt + coalesce(positive_total, 0) AS total_debt,
       CASE WHEN income > 0 THEN (loan_debt + coalesce(positive_total, 0)) / income ELSE 0 END AS debt_to_income_ratio,
       CASE WHEN limit_total > 0 AND limits > 0 THEN balance_total / balances / (limit_total / limits) ELSE 0 END
           AS credit_utilization,
       round(coalesce(spread, 0), 4) AS account_stability
FROM online_inputs

-- view known_events
SELECT e.transaction_id, e.customer_id, p.institution_id, p.source_system, e.transaction_type, e.transaction_date,
       e.amount, e.expected_amount AS given_expected, e.days_past_due AS given_days, e.event_time, e.event_id,
       e.event_type,
       coalesce(e.expected_amount, CASE WHEN e.transaction_type = 'LOAN_PAYMENT' THEN e.amount
                                        ELSE greatest(e.amount * 1.5::DOUBLE, 1) END) AS expected_amount,
       greatest(e.days_past_due, 0) AS days_past_due,
       CASE WHEN e.transaction_type = 'LOAN_PAYMENT' AND upper(e.status) IN ('ON_TIME', 'LATE', 'PAST_DUE')
                THEN upper(e.status)
            WHEN e.transaction_type = 'LOAN_PAYMENT' THEN CASE WHEN e.days_past_due > 0 THEN 'LATE' ELSE 'ON_TIME' END
            WHEN upper(e.status) IN ('CURRENT', 'PAST_DUE') THEN upper(e.status)
            WHEN e.days_past_due > 0 THEN 'PAST_DUE' ELSE 'CURRENT' END AS status,
       coalesce(e.reference_id, CASE WHEN e.transaction_type = 'LOAN_PAYMENT' THEN 'SIM_LOAN_' ELSE 'SIM_ACC_' END
           || e.customer_id) AS reference_id
FROM raw_events e LEFT JOIN profile p ON p.customer_id = e.customer_id

-- view accepted_events
SELECT * FROM known_events WHERE customer_id IN (SELECT customer_id FROM profile)

-- view trail_rows
SELECT customer_id, 0 AS phase, TIMESTAMP '1970-01-01' AS event_time, transaction_id, transaction_type,
       transaction_date, amount, credit_limit, reference_id, days_past_due
FROM online_rows
UNION ALL
SELECT customer_id, 1, event_time, transaction_id, transaction_type, transaction_date, amount,
       CASE WHEN expected_amount > 0 THEN expected_amount END, reference_id, days_past_due
FROM accepted_events

-- view trail_flags
SELECT *, transaction_type = 'LOAN_PAYMENT' AS pay, transaction_type = 'BALANCE_SNAPSHOT' AS bal,
       CASE WHEN transaction_type = 'BALANCE_SNAPSHOT'
            AND row_number() OVER (PARTITION BY customer_id, transaction_type, reference_id
                                   ORDER BY phase, event_time, transaction_id) = 1 THEN 1 ELSE 0 END AS new_account
FROM trail_rows

-- view trail_totals
SELECT customer_id, phase, event_time, transaction_id,
       sum(CASE WHEN pay THEN 1 ELSE 0 END) OVER w AS total_payments,
       sum(CASE WHEN pay AND days_past_due > 0 THEN 1 ELSE 0 END) OVER w AS late_payments,
       sum(new_account) OVER w AS total_accounts,
       min(CASE WHEN bal THEN transaction_date END) OVER w AS first_snapshot,
       sum(CASE WHEN bal THEN 1 ELSE 0 END) OVER w AS balances,
       CAST(sum(CASE WHEN bal THEN CAST(amount AS DECIMAL(38, 8)) ELSE 0 END) OVER w AS DOUBLE) AS balance_total,
       max(CASE WHEN bal THEN amount END) OVER w AS max_balance,
       min(CASE WHEN bal THEN amount END) OVER w AS min_balance,
       stddev_samp(CASE WHEN bal THEN amount END) OVER w AS spread,
       count(CASE WHEN bal THEN credit_limit END) OVER w AS limits,
       CAST(sum(CASE WHEN bal THEN CAST(credit_limit AS DECIMAL(38, 8)) END) OVER w AS DOUBLE) AS limit_total,
       max(CASE WHEN bal THEN days_past_due END) OVER w AS overdue_max,
       avg(CASE WHEN bal THEN days_past_due END) OVER w AS overdue_avg,
       CAST(sum(CASE WHEN bal THEN CAST(greatest(amount, 0) AS DECIMAL(38, 8)) ELSE 0 END) OVER w AS DOUBLE)
           AS positive_total
FROM trail_flags
WINDOW w AS (PARTITION BY customer_id ORDER BY phase, event_time, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)

-- view trail_features
SELECT a.transaction_id, a.event_time, a.customer_id, coalesce(i.institution_id, 'unknown') AS institution_id,
       coalesce(i.source_system, 'unknown') AS source_system,
       CAST(a.total_accounts AS INTEGER) AS total_accounts,
       CAST(greatest(coalesce(CAST(a.event_time AS DATE) - a.first_snapshot, 0), 0) AS INTEGER) AS account_age_days,
       coalesce(a.balance_total / nullif(a.balances, 0), 0) AS avg_balance,
       coalesce(a.max_balance, 0) AS max_balance, coalesce(a.min_balance, 0) AS min_balance,
       CAST(i.total_loans AS INTEGER) AS total_loans, CAST(i.active_loans AS INTEGER) AS active_loans,
       CAST(i.closed_loans AS INTEGER) AS closed_loans, CAST(a.total_payments AS INTEGER) AS total_payments,
       CAST(a.late_payments AS INTEGER) AS late_payments,
       coalesce(a.late_payments::DOUBLE / nullif(a.total_payments, 0), 0) AS late_payment_ratio,
       coalesce(greatest(i.loan_overdue_max, a.overdue_max), 0) AS max_days_past_due,
       (coalesce(i.loan_overdue_avg, 0) + coalesce(a.overdue_avg, 0))
           / CASE WHEN i.loan_overdue_avg IS NOT NULL AND a.overdue_avg IS NOT NULL THEN 2 ELSE 1 END
           AS avg_days_past_due,
       i.loan_debt + a.positive_total AS total_debt,
       CASE WHEN i.income > 0 THEN (i.loan_debt + a.positive_total) / i.income ELSE 0 END AS debt_to_income_ratio,
       CASE WHEN a.limit_total > 0 AND a.limits > 0 THEN a.balance_total / a.balances / (a.limit_total / a.limits)
            ELSE 0 END AS credit_utilization,
       round(coalesce(a.spread, 0), 4) AS account_stability
FROM trail_totals a JOIN online_inputs i ON i.customer_id = a.customer_id
WHERE a.phase = 1

-- view trail_scores
SELECT *, CAST(greatest(300, least(850, round_even(600 - 20 / ln(2.0) * ln(11.650360581192938::DOUBLE)
              + 20 / ln(2.0) * ln((1 - p) / p), 0))) AS INTEGER) AS credit_score,
       CASE WHEN p <= 0.05 THEN 'LOW' WHEN p <= 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(-2.3946103913682166::DOUBLE
             + 1.1236752427476158::DOUBLE * ln(raw / (1 - raw))))))) AS p
      FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(
                -0.5::DOUBLE + -0.05::DOUBLE * total_accounts + -0.0002::DOUBLE * account_age_days
                + 0.04::DOUBLE * active_loans + 3.0::DOUBLE * late_payment_ratio
                + 0.02::DOUBLE * max_days_past_due + 0.01::DOUBLE * debt_to_income_ratio
                + 0.4::DOUBLE * credit_utilization))))) AS raw FROM trail_features))

-- view trail_last
SELECT * FROM trail_scores
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_time DESC, transaction_id DESC) = 1

-- view what_if_rows
SELECT e.transaction_id AS scenario_id, r.customer_id, r.transaction_type, r.transaction_date, r.transaction_id,
       r.amount, r.credit_limit, r.reference_id, r.days_past_due
FROM accepted_events e JOIN online_rows r ON r.customer_id = e.customer_id
UNION ALL
SELECT transaction_id, customer_id, transaction_type, transaction_date, 'WHATIF', amount,
       CASE WHEN expected_amount > 0 THEN expected_amount END, reference_id, days_past_due
FROM accepted_events

-- view what_if_activity
SELECT scenario_id, customer_id,
       count(*) FILTER (WHERE transaction_type = 'LOAN_PAYMENT') AS total_payments,
       count(*) FILTER (WHERE transaction_type = 'LOAN_PAYMENT' AND days_past_due > 0) AS late_payments,
       count(DISTINCT reference_id) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS total_accounts,
       min(transaction_date) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS first_snapshot,
       avg(amount) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS avg_balance,
       stddev_samp(amount) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS spread,
       avg(credit_limit) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS avg_limit,
       max(days_past_due) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT') AS overdue_max,
       coalesce(sum(greatest(amount, 0)) FILTER (WHERE transaction_type = 'BALANCE_SNAPSHOT'), 0) AS positive_total
FROM what_if_rows GROUP BY scenario_id, customer_id

-- view what_if_raw
SELECT a.*, i.active_loans, coalesce(greatest(i.loan_overdue_max, a.overdue_max), 0) AS max_days_past_due,
       greatest(coalesce(DATE '2024-02-01' - a.first_snapshot, 0), 0) AS account_age_days,
       coalesce(a.late_payments::DOUBLE / nullif(a.total_payments, 0), 0) AS late_payment_ratio,
       CASE WHEN i.income > 0 THEN (i.loan_debt + a.positive_total) / i.income ELSE 0 END AS dti,
       coalesce(CASE WHEN a.avg_limit > 0 THEN a.avg_balance / a.avg_limit END, 0) AS used
FROM what_if_activity a JOIN online_inputs i ON i.customer_id = a.customer_id

-- view what_if_scores
SELECT *, CAST(greatest(300, least(850, round_even(600 - 20 / ln(2.0) * ln(11.650360581192938::DOUBLE)
              + 20 / ln(2.0) * ln((1 - p) / p), 0))) AS INTEGER) AS credit_score,
       CASE WHEN p <= 0.05 THEN 'LOW' WHEN p <= 0.15 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level
FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(-2.3946103913682166::DOUBLE
             + 1.1236752427476158::DOUBLE * ln(raw / (1 - raw))))))) AS p
      FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(
                -0.5::DOUBLE + -0.05::DOUBLE * total_accounts + -0.0002::DOUBLE * account_age_days
                + 0.04::DOUBLE * active_loans + 3.0::DOUBLE * late_payment_ratio
                + 0.02::DOUBLE * max_days_past_due + 0.01::DOUBLE * dti + 0.4::DOUBLE * used))))) AS raw
            FROM what_if_raw))

-- view train_quota
SELECT default_flag, CAST(quota + CASE WHEN row_number() OVER (ORDER BY share - quota DESC, default_flag)
           <= train - sum(quota) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
FROM (SELECT default_flag, train, train * n / total AS share, floor(train * n / total) AS quota
      FROM (SELECT default_flag, n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS total,
                   (sum(n) OVER () - ceil(sum(n) OVER () * 0.2::DOUBLE))::DOUBLE AS train
            FROM (SELECT default_flag, count(*) AS n FROM gold_features GROUP BY default_flag)))

-- view split
SELECT f.customer_id, f.default_flag,
       row_number() OVER (PARTITION BY f.default_flag ORDER BY md5('42:' || f.customer_id), f.customer_id) <= q.quota
           AS is_train
FROM gold_features f JOIN train_quota q ON q.default_flag = f.default_flag

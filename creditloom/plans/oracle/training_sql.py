"""SQL for bins, the first boosted tree and the calibration, step by step from their definitions."""

from __future__ import annotations

import math

from creditloom.schemas import FEATURE_COLUMNS

BINS, LEAVES, SHARE, SEED, LEAST_ROWS, LEAST_HESSIAN = 255, 31, 0.8, 42, 20, 0.001
UNIT = 2.0**-32

# customers of the training part with their features as (place, feature, value), stability to four digits
_VALUES = " UNION ALL ".join(
    f"SELECT f.customer_id, f.default_flag, {i} AS place, '{c}' AS feature, "
    + (f"round(f.{c}, 4)" if c == "account_stability" else f"f.{c}::DOUBLE")
    + " AS value FROM gold_features f JOIN split s ON s.customer_id = f.customer_id WHERE s.is_train"
    for i, c in enumerate(FEATURE_COLUMNS)
)

_EDGES = f"""
tall AS MATERIALIZED ({_VALUES}),
counted AS (
    SELECT feature, place, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS up_to,
        sum(n) OVER (PARTITION BY feature) AS n_rows, count(*) OVER (PARTITION BY feature) AS n_values
    FROM (SELECT feature, place, value, count(*) AS n FROM tall GROUP BY ALL)
),
edges AS MATERIALIZED (
    SELECT feature, place, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS position, value AS edge
    FROM counted
    WHERE up_to < n_rows
        AND (n_values <= {BINS} OR floor(up_to * {BINS} / n_rows) > floor((up_to - n) * {BINS} / n_rows))
)"""


def bins() -> str:
    return f"SELECT * FROM (WITH {_EDGES} SELECT feature, position::INT AS position, edge FROM edges)"


def first_tree() -> str:
    """The best leaf's split, over and over: each step adds up gradients per leaf, feature and bin anew."""
    chosen = math.floor(len(FEATURE_COLUMNS) * SHARE + 0.5)
    steps = [
        f"""coded AS MATERIALIZED (
    SELECT t.customer_id, t.place, count(e.edge) AS code,
        round(any_value(w.weight) * (0.5 - any_value(t.default_flag)) / {UNIT!r})::BIGINT AS g,
        round(any_value(w.weight) * 0.25 / {UNIT!r})::BIGINT AS h
    FROM tall t JOIN weights w ON w.default_flag = t.default_flag
        LEFT JOIN edges e ON e.feature = t.feature AND e.edge < t.value
    WHERE t.feature IN (SELECT feature FROM (SELECT DISTINCT feature, place FROM tall)
        ORDER BY md5('{SEED}:0:' || feature), place LIMIT {chosen})
    GROUP BY t.customer_id, t.place
)""",
        """weights AS (
    SELECT default_flag, sum(n) OVER ()::DOUBLE / (count(*) OVER () * n) AS weight
    FROM (SELECT default_flag, count(*) AS n FROM tall WHERE place = 0 GROUP BY default_flag)
)""",
        "leaf0 AS MATERIALIZED (SELECT DISTINCT customer_id, 0 AS leaf FROM tall)",
    ]
    steps[0], steps[1] = steps[1], steps[0]
    for s in range(1, LEAVES):
        steps.append(
            f"""best{s} AS MATERIALIZED (
    SELECT leaf, place, code, gl * gl / hl + gr * gr / hr - gt * gt / ht AS gain, nl, nt - nl AS nr
    FROM (
        SELECT leaf, place, code, nl, nt, gl * {UNIT!r} AS gl, hl * {UNIT!r} AS hl, (gt - gl) * {UNIT!r} AS gr,
            (ht - hl) * {UNIT!r} AS hr, gt * {UNIT!r} AS gt, ht * {UNIT!r} AS ht
        FROM (
            SELECT leaf, place, code, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
                sum(g) OVER v AS gt, sum(h) OVER v AS ht, sum(n) OVER v AS nt
            FROM (SELECT leaf, place, code, sum(g) AS g, sum(h) AS h, count(*) AS n
                  FROM coded JOIN leaf{s - 1} USING (customer_id) GROUP BY leaf, place, code)
            WINDOW w AS (PARTITION BY leaf, place ORDER BY code), v AS (PARTITION BY leaf, place)
        )
    )
    WHERE nl >= {LEAST_ROWS} AND nt - nl >= {LEAST_ROWS} AND hl >= {LEAST_HESSIAN} AND hr >= {LEAST_HESSIAN}
        AND gl * gl / hl + gr * gr / hr - gt * gt / ht > 1e-9
    ORDER BY gain DESC, leaf, place, code LIMIT 1
),
leaf{s} AS MATERIALIZED (
    SELECT l.customer_id, CASE WHEN c.code > b.code THEN {s} ELSE l.leaf END AS leaf
    FROM leaf{s - 1} l LEFT JOIN best{s} b ON b.leaf = l.leaf
        LEFT JOIN coded c ON c.customer_id = l.customer_id AND c.place = b.place
)"""
        )
    rows = " UNION ALL ".join(f"SELECT {s} AS step, * FROM best{s}" for s in range(1, LEAVES))
    return f"""
SELECT * FROM (WITH {_EDGES}, {", ".join(steps)}
SELECT r.step, r.leaf, e.feature, e.edge, round(r.gain, 6) AS gain, r.nl::BIGINT AS left_rows, r.nr::BIGINT AS right_rows
FROM ({rows}) r JOIN edges e ON e.place = r.place AND e.position = r.code)
"""


# Newton steps for the sum of losses plus half the squared slope, without any step control
PLATT = """
SELECT * FROM (WITH RECURSIVE points AS (
    SELECT default_flag AS y, ln(p / (1 - p)) AS z
    FROM (SELECT default_flag, greatest(1e-6, least(1 - 1e-6, raw_p)) AS p FROM model_raw)
),
newton(step, a, b) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
    FROM (
        SELECT step, a, b, sum(p - y) AS ga, sum((p - y) * z) + b AS gb, sum(p * (1 - p)) AS haa,
            sum(p * (1 - p) * z) AS hab, sum(p * (1 - p) * z * z) + 1 AS hbb
        FROM (SELECT step, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM newton, points WHERE step < 20)
        GROUP BY step, a, b
    )
)
SELECT round(a, 6) AS intercept, round(b, 6) AS slope,
    (SELECT round(sum(ln(1 + exp(a + b * z)) - y * (a + b * z)) + b * b / 2, 6) FROM points) AS loss,
    (SELECT count(*) FROM points) AS row_count
FROM newton WHERE step = 20)
"""

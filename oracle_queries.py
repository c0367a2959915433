"""DuckDB SQL for the registered queries, each on the raw benchmark tables."""

from __future__ import annotations

import math

CAMERAS = """
cameras AS (
  SELECT s.s_suppkey AS camera_id, 'EQ-' || CAST(s.s_nationkey AS VARCHAR) AS equipment_id,
         r.r_name AS address,
         CASE WHEN s.s_suppkey % 23 = 22 THEN NULL
              ELSE CAST(3.0 + (s.s_suppkey % 50) * 0.01 AS DOUBLE) END AS latitude,
         CAST(101.5 + (s.s_suppkey % 40) * 0.01 AS DOUBLE) AS longitude
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

EVENTS = """
detections AS (
  SELECT ts AS time, user_id AS camera_id,
         CASE WHEN event_id % 5 IN (0, 1) THEN 'IN' WHEN event_id % 5 IN (2, 3) THEN 'OUT' END
           AS direction,
         CASE WHEN event_id % 17 = 0 THEN NULL
              ELSE (CASE WHEN user_id % 2 = 0 THEN 'b2t_' ELSE 't2b_' END)
                   || CAST(event_id % 3 + 1 AS VARCHAR) END AS zone,
         et AS event_type,
         CASE event_id % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'lorry' WHEN 2 THEN 'motorbike'
                           ELSE 'person' END AS item_type,
         CASE WHEN event_id % 19 = 0 THEN '{}'
              WHEN et = 'person_on_lane' THEN '{"id":1,"conf":0.' || kk || ',"x":1}'
              ELSE '{"id":1,"confidence":0.' || kk || '}' END AS description
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 'person_on_lane' WHEN 'view' THEN 'illegal_stop'
                                  WHEN 'purchase' THEN 'accident' ELSE event_type END AS et,
               lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0') AS kk
        FROM events)
)"""

VOLUMES = """
readings AS (
  SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(h + h // 10 AS INT)
           + INTERVAL 1 MINUTE * CAST(l_partkey % 60 AS INT) AS time,
         l_suppkey AS camera_id,
         CASE l_returnflag WHEN 'A' THEN 'IN' WHEN 'N' THEN 'OUT' END AS destination,
         (CASE l_linestatus WHEN 'F' THEN 'b2t_' ELSE 't2b_' END)
           || CAST(l_linenumber % 3 + 1 AS VARCHAR) AS zone,
         vehicle_type,
         CAST(l_quantity AS INT) * CASE WHEN vehicle_type = 'ALL' THEN 8 ELSE 1 END AS agg_count,
         CASE WHEN l_orderkey % 29 = 0 THEN NULL
              ELSE CAST(round(l_discount * 100) - 1 AS INT) * 10 END AS avg_speed
  FROM (SELECT *, CASE l_partkey % 7 WHEN 0 THEN 'ALL' WHEN 1 THEN 'bus' WHEN 2 THEN 'car'
                    WHEN 3 THEN 'lorry' WHEN 4 THEN 'truck' WHEN 5 THEN 'van'
                    ELSE 'motorbike' END AS vehicle_type,
               CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS h
        FROM lineitem)
)"""

WIDE_ROADS = "'AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'"
SOME_ROADS = "'ASIA', 'EUROPE', 'AFRICA'"
WIDE = (WIDE_ROADS, "'IN', 'OUT'", "")
NARROW = (
    "'ASIA'", "'IN'",
    "AND t1.time >= TIMESTAMP '2024-01-01 00:00:00' AND t1.time < TIMESTAMP '2024-01-03 01:00:00'",
)


def _lenient(field: str) -> str:
    """Leading number of the text after the last field name, 0 if there is none."""
    number = (
        f"regexp_extract(split_part(list_last(string_split(t1.description, '{field}')), ',', 1), "
        r"'^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1)"
    )
    return (
        f"CASE WHEN t1.description IS NULL THEN NULL "
        f"ELSE CAST(coalesce(nullif({number}, ''), '0') AS DECIMAL(5,4)) END"
    )


def _event_facts(selection=WIDE) -> str:
    roads, directions, span = selection
    return f"""
WITH {CAMERAS}, {EVENTS}, detected AS (
  SELECT date_trunc('hour', t1.time) AS datetime, t2.address, t2.camera_id, t1.direction, t1.zone,
         t1.event_type, t1.item_type,
         CASE WHEN t1.event_type = 'person_on_lane' THEN {_lenient('"conf":')}
              WHEN t1.event_type IN ('illegal_stop', 'accident') THEN {_lenient('"confidence":')}
         END AS conf
  FROM detections t1 JOIN cameras t2 ON t1.camera_id = t2.camera_id
  WHERE t2.address IN ({roads}) AND t1.direction IN ({directions}) {span}
), facts AS (
  -- The mean has eight decimals, rounded half up; whole-number arithmetic keeps that exact.
  SELECT datetime, address, camera_id, direction, zone, event_type, item_type,
         CAST((2 * CAST(sum(conf) * 10000 AS BIGINT) * 10000 + count(conf)) // (2 * count(conf))
              AS DOUBLE) / 100000000 AS confidence
  FROM detected
  GROUP BY ALL
)"""


def _volume_facts(selection=WIDE) -> str:
    roads, directions, span = selection
    counts = ",\n         ".join(
        f"CAST(sum(CASE WHEN vehicle_type = '{kind}' THEN agg_count ELSE 0 END) AS BIGINT) AS {name}"
        for kind, name in (
            ("bus", "bus_count"), ("car", "car_count"), ("lorry", "lorry_count"),
            ("truck", "truck_count"), ("van", "van_count"), ("motorbike", "motorbike_count"),
            ("ALL", "total_count"),
        )
    )
    return f"""
WITH {CAMERAS}, {VOLUMES}, grouped AS (
  SELECT date_trunc('hour', t1.time) AS datetime, t2.address, t2.equipment_id, t2.camera_id,
         t1.destination, left(t1.zone, 3) AS "POV",
         {counts},
         avg(CASE WHEN avg_speed > 0 AND vehicle_type NOT IN ('ALL', 'motorbike')
                  THEN avg_speed END) AS lane_speed,
         avg(CASE WHEN avg_speed > 0 AND vehicle_type = 'motorbike' THEN avg_speed END)
           AS motor_speed,
         count(DISTINCT CASE WHEN avg_speed < 0 AND vehicle_type IN ('ALL', 'motorbike') THEN NULL
                             ELSE t1.zone END) AS indicator
  FROM readings t1 JOIN cameras t2 ON t1.camera_id = t2.camera_id
  WHERE t2.address IN ({roads}) AND t1.destination IN ({directions}) {span}
  GROUP BY 1, 2, 3, 4, 5, 6
), facts AS (
  SELECT *, CAST(total_count - motorbike_count AS DOUBLE) / nullif(lane_speed * indicator, 0)
              AS "LOS"
  FROM grouped
)"""


def _crosstab(key: str, where: str, order: str = "") -> str:
    return f"""{_event_facts()}, counts AS (
  SELECT {key}, event_type, count(*) AS n FROM facts
  WHERE event_type IS NOT NULL AND {where} GROUP BY 1, 2
)
SELECT k.{key}, t.event_type, coalesce(n, 0) AS events
FROM (SELECT DISTINCT {key} FROM counts) k CROSS JOIN (SELECT DISTINCT event_type FROM counts) t
     LEFT JOIN counts c ON c.{key} = k.{key} AND c.event_type = t.event_type {order}"""


def _hourly_counts(direction: str) -> str:
    return f"""{_event_facts()}, counts AS (
  SELECT datetime, event_type, count(*) AS n FROM facts
  WHERE direction = '{direction}' AND event_type IS NOT NULL GROUP BY 1, 2
), hours AS (
  SELECT unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime
  FROM counts
), seen AS (SELECT DISTINCT datetime FROM counts),
grid AS (SELECT datetime, event_type FROM hours, (SELECT DISTINCT event_type FROM counts)),
filled AS (
  SELECT g.datetime, g.event_type, s.datetime IS NULL AS gap,
         CASE WHEN s.datetime IS NOT NULL THEN coalesce(c.n, 0) END AS n
  FROM grid g LEFT JOIN counts c ON g.datetime = c.datetime AND g.event_type = c.event_type
              LEFT JOIN seen s ON g.datetime = s.datetime
)
SELECT datetime, event_type,
       CAST(last_value(n IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY datetime) AS BIGINT)
         AS events,
       gap
FROM filled"""


HOURLY_LOS = f"""{_volume_facts()}, means AS (
  SELECT datetime, destination, avg("LOS") AS y FROM facts GROUP BY 1, 2 HAVING avg("LOS") IS NOT NULL
), hours AS (
  SELECT unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM means
), hourly AS (
  SELECT h.datetime, k.destination,
         last_value(m.y IGNORE NULLS) OVER (PARTITION BY k.destination ORDER BY h.datetime) AS "LOS",
         m.y IS NULL AS gap
  FROM hours h CROSS JOIN (SELECT DISTINCT destination FROM means) k
       LEFT JOIN means m ON m.datetime = h.datetime AND m.destination = k.destination
)"""

SPLIT = f"""{HOURLY_LOS}, numbered AS (
  SELECT destination, datetime, "LOS" AS y,
         CAST(row_number() OVER (PARTITION BY destination ORDER BY datetime) AS INT) AS position,
         CAST(count(*) OVER (PARTITION BY destination) AS INT) AS hours
  FROM hourly WHERE "LOS" IS NOT NULL
), split AS (
  SELECT *, CASE WHEN position > hours - ceil(hours * CAST(0.3 AS DOUBLE)) THEN 'test'
                 ELSE 'train' END AS split
  FROM numbered
)"""

MODEL = f"""{SPLIT}, pairs AS (
  SELECT *, lag(y) OVER (PARTITION BY destination ORDER BY position) AS x
  FROM split WHERE split = 'train'
), line AS (
  SELECT destination, CAST(count(*) AS INT) AS n_train, max_by(y, position) AS last_y,
         CAST(regr_count(y, x) AS INT) AS n, regr_slope(y, x) AS slope,
         regr_intercept(y, x) AS icept, regr_syy(y, x) * (1 - regr_r2(y, x)) AS sse
  FROM pairs GROUP BY destination
), usable AS (
  SELECT destination, n_train, n, last_y,
         CASE WHEN n >= 3 AND abs(slope) < 1 THEN slope END AS phi,
         CASE WHEN n >= 3 AND abs(slope) < 1 THEN icept END AS intercept,
         CASE WHEN n >= 3 AND abs(slope) < 1 THEN greatest(sse, 0) END AS sse
  FROM line
), model AS (
  SELECT destination, 1 AS p, 0 AS d, n_train, n, last_y, phi, intercept,
         sqrt(sse / (n - 2)) AS sigma,
         CASE WHEN sse > 0 THEN n * ln(sse / n) + 2 * (1 + 2) END AS aic
  FROM usable
)"""

_PATH = """coalesce(intercept / (1 - phi) + pow(phi, ahead) * (last_y - intercept / (1 - phi)), last_y)"""
_HALF = """1.6448536269514722 * sigma * sqrt((1 - pow(phi * phi, ahead)) / (1 - phi * phi))"""

BACKTEST = f"""{MODEL}, joined AS (
  SELECT s.*, m.* EXCLUDE (destination),
         CASE WHEN position > n_train THEN position - n_train END AS ahead
  FROM split s JOIN model m ON s.destination = m.destination
), backtest AS (
  SELECT destination, datetime, CASE WHEN split = 'train' THEN y END AS training_data,
         CASE WHEN split = 'test' THEN y END AS test_data,
         CASE WHEN ahead IS NOT NULL THEN {_PATH} END AS prediction,
         CASE WHEN ahead IS NOT NULL THEN {_PATH} - {_HALF} END AS lower,
         CASE WHEN ahead IS NOT NULL THEN {_PATH} + {_HALF} END AS upper
  FROM joined
)"""

FORECAST = f"""{MODEL}, ahead_of AS (
  SELECT s.destination, s.datetime, s.hours, i.step, m.* EXCLUDE (destination),
         s.hours - m.n_train + i.step AS ahead
  FROM split s JOIN model m ON s.destination = m.destination
       CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS step) i
  WHERE s.position = s.hours
)
SELECT destination, datetime, y AS observed, CAST(NULL AS DOUBLE) AS forecast,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM split
UNION ALL
SELECT destination, datetime + INTERVAL 1 HOUR * CAST(step AS INT), NULL,
       {_PATH}, {_PATH} - {_HALF}, {_PATH} + {_HALF}
FROM ahead_of"""


STATIONARITY = f"""{SPLIT}, levels AS (
  SELECT destination, position, unnest([0, 1, 2]) AS d, unnest([
           y, y - lag(y) OVER w, y - 2 * lag(y) OVER w + lag(y, 2) OVER w]) AS v
  FROM split WHERE split = 'train' WINDOW w AS (PARTITION BY destination ORDER BY position)
), deviations AS (
  SELECT destination, d, position, v, v - avg(v) OVER g AS e, count(*) OVER g AS n,
         CAST(floor(3 * sqrt(count(*) OVER g) / 13) AS INT) AS lags
  FROM levels WHERE v IS NOT NULL WINDOW g AS (PARTITION BY destination, d)
), products AS (
  -- Bartlett weights on the autocovariances, lag by lag.
  SELECT destination, d, sum(a.e * b.e * CASE l WHEN 0 THEN 1.0 ELSE 2 * (1 - l / (a.lags + 1.0)) END)
           AS long_run
  FROM (SELECT destination, d, position - l AS position, l, lags, e
        FROM (SELECT *, unnest(range(0, lags + 1)) AS l FROM deviations)) a
       JOIN deviations b USING (destination, d, position)
  GROUP BY 1, 2
), cumulated AS (
  SELECT *, sum(e) OVER (PARTITION BY destination, d ORDER BY position) AS c FROM deviations
), statistics AS (
  SELECT destination, d, max(n) AS n, max(lags) AS lags,
         CASE WHEN sum(e * e) > 1e-20 * sum(v * v) AND max(n) > 1
              THEN sum(c * c) / (max(n) * max(long_run)) END AS statistic
  FROM cumulated JOIN products USING (destination, d) GROUP BY 1, 2
), choice AS (
  SELECT destination, max(statistic) FILTER (d = 0) AS level_0,
         max(statistic) FILTER (d = 1) AS level_1, max(statistic) FILTER (d = 2) AS level_2,
         CAST(max(n) FILTER (d = 0) AS INT) AS n, CAST(max(lags) FILTER (d = 0) AS INT) AS lags,
         CAST(coalesce(min(d) FILTER (statistic IS NULL OR statistic <= CAST(0.463 AS DOUBLE)), 2) AS INT)
           AS d
  FROM statistics GROUP BY 1
)"""


def _by_order(chosen: bool = False) -> str:
    """Autoregressions of order 0 to 5 by successive orthogonalisation, least AIC.

    Not the normal equations: each lag is freed of the lags before it, which gives every order's
    residual sum; coefficients follow by back-substitution and stationarity by stepping the order
    down until a reflection coefficient leaves the unit interval.
    """
    lags = range(1, 6)
    names = [f"u{k}" for k in lags]
    values = "SELECT *, 0 AS d, y AS v FROM split WHERE split = 'train'"
    if chosen:
        values = """SELECT s.*, d, CASE d WHEN 0 THEN y WHEN 1 THEN y - lag(y) OVER w
                     ELSE y - 2 * lag(y) OVER w + lag(y, 2) OVER w END AS v
  FROM split s JOIN (SELECT destination, d FROM choice) USING (destination)
  WHERE split = 'train' WINDOW w AS (PARTITION BY s.destination ORDER BY position)"""
    steps = [f"""train_rows AS (
  SELECT destination, position, d, y, v, avg(v) OVER p AS center,
         v - avg(v) OVER p AS z, CAST(count(*) OVER p AS INT) AS n_train,
         CAST(hours - count(*) OVER p AS INT) AS n_test
  FROM ({values}) WINDOW p AS (PARTITION BY destination)
), lagged AS (
  SELECT *, {", ".join(f"lag(z, {k}) OVER w AS l{k}" for k in lags)}
  FROM train_rows WINDOW w AS (PARTITION BY destination ORDER BY position)
), g0 AS (
  SELECT destination, center, count(*) OVER p AS n, sum(z * z) OVER p AS total,
         avg(z) OVER p AS mz, {", ".join(f"avg(l{k}) OVER p AS m{k}" for k in lags)},
         z - avg(z) OVER p AS r, {", ".join(f"l{k} - avg(l{k}) OVER p AS u{k}" for k in lags)}
  FROM lagged WHERE l5 IS NOT NULL WINDOW p AS (PARTITION BY destination)
)"""]
    for k in lags:
        later = range(k + 1, 6)
        shares = "".join(
            f", sum(u{j} * u{k}) OVER p / sum(u{k} * u{k}) OVER p AS s{k}{j}" for j in later
        )
        freed = "".join(f", u{j} - s{k}{j} * u{k} AS u{j}" for j in later)
        dropped = ", ".join(["r", *names[k - 1:]])
        steps.append(f"""c{k} AS (
  SELECT *, sum(r * r) OVER p AS sse{k - 1}, sum(r * u{k}) OVER p / sum(u{k} * u{k}) OVER p AS b{k},
         sum(u{k} * u{k}) OVER p AS d{k} {shares}
  FROM g{k - 1} WINDOW p AS (PARTITION BY destination)
), g{k} AS (
  SELECT * EXCLUDE ({dropped}), r - b{k} * u{k} AS r {freed} FROM c{k}
)""")
    steps.append("""sums AS (
  SELECT DISTINCT * EXCLUDE (r), sum(r * r) OVER (PARTITION BY destination) AS sse5 FROM g5
)""")
    for p in range(6):
        columns = []
        for j in range(p, 0, -1):
            rest = "".join(f" - s{j}{m} * f{m}" for m in range(j + 1, p + 1))
            columns.append(f"b{j}{rest} AS f{j}")
        current = [f"f{j}" for j in range(1, p + 1)]
        inside = []
        for m in range(p, 0, -1):
            last = current[m - 1]
            inside.append(f"abs({last}) < 1")
            reduced = []
            for i in range(1, m):
                name = f"a{m - 1}_{i}"
                columns.append(
                    f"({current[i - 1]} + {last} * {current[m - i - 1]}) / (1 - {last} * {last})"
                    f" AS {name}"
                )
                reduced.append(name)
            current = reduced
        solved = "".join(f", {column}" for column in columns)
        zeros = "".join(f", CAST(NULL AS DOUBLE) AS f{j}" for j in range(p + 1, 6))
        steps.append(f"""order{p} AS (
  SELECT destination, {p} AS p, n, total, center, mz, {", ".join(f"m{k}" for k in lags)},
         sse{p} AS sse {solved} {zeros}, {" AND ".join(inside) or "true"} AS inside
  FROM sums
)""")
    kept = f"destination, p, n, total, center, mz, {', '.join(f'm{k}' for k in lags)}, sse, " + (
        ", ".join(f"f{k}" for k in lags)
    )
    union = " UNION ALL ".join(f"SELECT {kept}, inside FROM order{p}" for p in range(6))
    weights = " + ".join(f"coalesce(f{k}, 0)" for k in lags)
    means = " + ".join(f"coalesce(f{k}, 0) * m{k}" for k in lags)
    lengths = "max(n_train) AS n_train, max(n_test) AS n_test, max_by(y, position) AS last_y"
    recent = ", ".join(
        f"max(CASE WHEN position = n_train - {k - 1} THEN y END) AS y{k}" for k in lags
    )
    steps.append(f"""candidates AS (
  SELECT *, n * ln(sse / n) + 2 * (p + 2) AS aic FROM ({union}) o
  WHERE n >= 8 AND inside AND sse > 1e-12 * total
), best AS (
  SELECT * FROM candidates
  QUALIFY row_number() OVER (PARTITION BY destination ORDER BY aic, p) = 1
), model AS (
  SELECT t.destination, b.p, t.d, t.n_train, t.n_test,
         CAST(coalesce(b.n, greatest(t.n_train - t.d - 5, 0)) AS INT) AS n, t.last_y,
         center * (1 - ({weights})) + mz - ({means}) AS intercept,
         sqrt(sse / (b.n - b.p - 1)) AS sigma, aic,
         {", ".join(f"f{k} AS phi_{k}" for k in lags)}, {", ".join(f"y{k}" for k in lags)}
  FROM (SELECT destination, max(d) AS d, {lengths}, {recent} FROM train_rows GROUP BY destination) t
       LEFT JOIN best b ON t.destination = b.destination
)""")
    if chosen:
        return STATIONARITY + ", " + ", ".join(steps)
    phi = [f"coalesce(phi_{k}, {'CASE WHEN p IS NULL THEN 1 ELSE 0 END' if k == 1 else 0})" for k in lags]
    start = " + ".join(f"{phi[k - 1]} * coalesce(y{k}, 0)" for k in lags)
    on = " + ".join(f"f{k} * v{k}" for k in lags)
    shock = " + ".join(f"f{k} * w{k}" for k in lags)
    carried = "destination, n_train, n_test, sigma, c, " + ", ".join(f"f{k}" for k in lags)
    steps.append(f"""path AS (
  SELECT destination, n_train, n_test, sigma, coalesce(intercept, 0) AS c,
         {", ".join(f"{phi[k - 1]} AS f{k}" for k in lags)}, 1 AS ahead,
         coalesce(intercept, 0) + {start} AS v1,
         {", ".join(f"y{k - 1} AS v{k}" for k in range(2, 6))},
         CAST(1 AS DOUBLE) AS w1, {", ".join(f"CAST(0 AS DOUBLE) AS w{k}" for k in range(2, 6))},
         CAST(1 AS DOUBLE) AS variance
  FROM model
  UNION ALL
  SELECT {carried}, ahead + 1, c + {on}, {", ".join(f"v{k}" for k in range(1, 5))},
         {shock}, {", ".join(f"w{k}" for k in range(1, 5))}, variance + ({shock}) * ({shock})
  FROM path WHERE ahead < n_test + 24
), predicted AS (
  SELECT destination, n_train + ahead AS position, v1 AS prediction,
         1.6448536269514722 * sigma * sqrt(variance) AS half
  FROM path
), backtest AS (
  SELECT s.destination, s.datetime, CASE WHEN split = 'train' THEN y END AS training_data,
         CASE WHEN split = 'test' THEN y END AS test_data, prediction,
         prediction - half AS lower, prediction + half AS upper
  FROM split s LEFT JOIN predicted a ON s.destination = a.destination AND s.position = a.position
)""")
    return SPLIT.replace("WITH", "WITH RECURSIVE", 1) + ", " + ", ".join(steps)


def _summary() -> str:
    """Standard errors by the inverse of the orthogonalisation; residuals and their moments."""
    lags = range(1, 6)
    inverse, errors = [], []
    for m in lags:
        inverse.append(f"1.0 AS v{m}{m}")
        for j in range(m - 1, 0, -1):
            rest = " + ".join(f"s{j}{i} * v{i}{m}" for i in range(j + 1, m + 1))
            inverse.append(f"-({rest}) AS v{j}{m}")
    for j in lags:
        parts = " + ".join(f"CASE WHEN p >= {m} THEN v{j}{m} * v{j}{m} / d{m} ELSE 0 END" for m in range(j, 6))
        errors.append(f"CASE WHEN p >= {j} THEN sigma * sqrt({parts}) END AS phi_{j}_se")
    means = " + ".join(
        f"CASE WHEN p >= {m} THEN pow({' + '.join(f'(center + m{j}) * v{j}{m}' for j in range(1, m + 1))}, 2)"
        f" / d{m} ELSE 0 END" for m in lags
    )
    expected = " + ".join(f"coalesce(phi_{k}, 0) * v_{k}" for k in lags)
    before = ", ".join(f"lag(v, {k}) OVER w AS v_{k}" for k in lags)
    autocorrelations = ", ".join(f"sum(e * e_{k}) / sum(e * e) AS a{k}" for k in range(1, 11))
    box = " + ".join(f"a{k} * a{k} / (n - {k})" for k in range(1, 11))
    tail = " + ".join(f"pow(ljung_box / 2, {k}) / {math.factorial(k)}" for k in range(5))
    shown = ", ".join(f"phi_{k}, phi_{k}_se, phi_{k} / phi_{k}_se AS phi_{k}_z" for k in lags)
    return f"""{_by_order(chosen=True)}, inverted AS (SELECT *, {", ".join(inverse)} FROM sums
), errors AS (
  SELECT i.destination, {", ".join(errors)}, sigma * sqrt(1.0 / i.n + {means}) AS intercept_se
  FROM inverted i JOIN (SELECT destination, p, sigma FROM model) USING (destination)
), residual AS (
  SELECT destination, n, row_number() OVER (PARTITION BY destination ORDER BY position) AS place,
         v - intercept - ({expected}) AS raw
  FROM (SELECT destination, position, v, {before} FROM train_rows
        WINDOW w AS (PARTITION BY destination ORDER BY position))
       JOIN model USING (destination)
  WHERE v_5 IS NOT NULL AND p IS NOT NULL
), centred AS (
  SELECT *, raw - avg(raw) OVER (PARTITION BY destination) AS e FROM residual
), shifted AS (
  SELECT *, {", ".join(f"lag(e, {k}) OVER w AS e_{k}" for k in range(1, 11))} FROM centred
  WINDOW w AS (PARTITION BY destination ORDER BY place)
), tests AS (
  SELECT destination, sum(e * e) / max(n) AS var, sum(e * e * e) / max(n) AS m3,
         sum(pow(e, 4)) / max(n) AS m4, {autocorrelations},
         sum(e * e) FILTER (place > n - (n + 1) // 3) / sum(e * e) FILTER (place <= (n + 1) // 3)
           AS heteroskedasticity
  FROM shifted GROUP BY destination
), told AS (
  SELECT m.* EXCLUDE (y1, y2, y3, y4, y5, n_test, last_y), x.* EXCLUDE (destination), heteroskedasticity,
         -n / 2.0 * (ln(2 * pi() * var) + 1) AS log_likelihood, n * ln(var) + (p + 2) * ln(n) AS bic,
         m3 / pow(var, 1.5) AS skewness, m4 / (var * var) AS kurtosis,
         CASE WHEN n > 10 THEN n * (n + 2) * ({box}) END AS ljung_box
  FROM model m LEFT JOIN errors x ON m.destination = x.destination
       LEFT JOIN tests t ON m.destination = t.destination
), judged AS (
  SELECT *, n / 6.0 * (pow(skewness, 2) + pow(kurtosis - 3, 2) / 4) AS jarque_bera FROM told
)
SELECT destination, p, d, n_train, n, intercept, intercept_se, intercept / intercept_se AS intercept_z,
       {shown}, sigma, log_likelihood, aic, bic, ljung_box, exp(-ljung_box / 2) * ({tail}) AS ljung_box_p,
       jarque_bera, exp(-jarque_bera / 2) AS jarque_bera_p, skewness, kurtosis, heteroskedasticity
FROM judged"""


SCORES = """
SELECT destination, count(*) AS n_test,
       avg(abs(test_data - prediction) / greatest(abs(test_data), 2.220446049250313e-16)) AS mape,
       sqrt(avg((test_data - prediction) * (test_data - prediction))) AS rmse
FROM backtest WHERE test_data IS NOT NULL GROUP BY destination"""

SCORES_OBSERVED = """
SELECT destination, count(*) AS n_test, count(*) FILTER (test_data = 0) AS n_zero,
       avg(abs(test_data - prediction) / abs(test_data)) FILTER (test_data <> 0) AS mape,
       sqrt(avg((test_data - prediction) * (test_data - prediction))) AS rmse
FROM backtest WHERE test_data IS NOT NULL GROUP BY destination"""


def _by_camera(sql: str) -> str:
    """The same for each camera and destination: the text after the facts with another key."""
    facts = _volume_facts()
    assert sql.startswith(facts)
    keyed = """, keyed AS (
  SELECT *, destination || '/' || CAST(camera_id AS VARCHAR) AS series FROM facts
)"""
    rest = sql.removeprefix(facts).replace("destination", "series").replace("FROM facts", "FROM keyed")
    return facts + keyed + rest


def oracle_sql() -> dict[str, str]:
    events, volumes, by_order = _event_facts(), _volume_facts(), _by_order()
    heat_map = f"""{volumes}, heat_map AS (
  SELECT f.destination, f.camera_id, c.latitude, c.longitude, avg(f."LOS") AS "LOS"
  FROM facts f LEFT JOIN (SELECT * FROM cameras WHERE address IN ({WIDE_ROADS})) c
       ON f.camera_id = c.camera_id
  WHERE c.latitude IS NOT NULL AND c.longitude IS NOT NULL
  GROUP BY 1, 2, 3, 4 HAVING avg(f."LOS") IS NOT NULL
)"""
    totals = ", ".join(
        f"CAST(coalesce(sum({kind}_count), 0) AS BIGINT) AS {kind}"
        for kind in ("bus", "car", "lorry", "truck", "van", "motorbike", "total")
    )
    hourly_totals = f"{volumes}, totals AS (SELECT datetime, {totals} FROM facts GROUP BY datetime)"
    bounds = ("24.36", "39.94", "57.73", "77.72", "100.0", "125.0")
    colours = ("#00901a", "#6db046", "#a38600", "#d9d61c", "#e66c37", "#ff0000")
    lines = ", ".join(
        f"({level}, CAST({bound} AS DOUBLE), '{colour}')"
        for level, (bound, colour) in enumerate(zip(bounds, colours), 1)
    )
    band = " + ".join(f'CAST("LOS" >= CAST({bound} AS DOUBLE) AS INT)' for bound in bounds)
    return {
        "important_roads": "SELECT r_name AS road FROM region",
        "hour_calendar": """
SELECT datetime, strftime(datetime, '%Y-%m-%d %H:00:00') AS hour_text,
       strftime(datetime, '%d %b %I %p') AS label
FROM (SELECT unnest(generate_series(date_trunc('hour', max(ts)) - INTERVAL 2 DAYS,
                                    date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS datetime
      FROM events)""",
        "cameras_on_roads": f"WITH {CAMERAS} SELECT * FROM cameras WHERE address IN ({SOME_ROADS})",
        "cameras_by_id": f"WITH {CAMERAS} SELECT * FROM cameras WHERE camera_id IN (2, 3, 5, 7)",
        "event_facts": f"{events} SELECT * FROM facts ORDER BY datetime DESC",
        "event_facts_one_road": f"{_event_facts(NARROW)} SELECT * FROM facts ORDER BY datetime DESC",
        "volume_facts": f"{volumes} SELECT * FROM facts ORDER BY datetime DESC",
        "volume_facts_one_road": (
            f"{_volume_facts(NARROW)} SELECT * FROM facts ORDER BY datetime DESC"
        ),
        "camera_unreadable_values": f"""
WITH {CAMERAS}, texts AS (
  SELECT CASE WHEN camera_id % 7 = 3 THEN 'C' || camera_id ELSE CAST(camera_id AS VARCHAR) END AS camera_id,
         equipment_id, address, CAST(latitude AS VARCHAR) AS latitude,
         CASE WHEN camera_id % 5 = 1 THEN 'unknown' ELSE CAST(longitude AS VARCHAR) END AS longitude
  FROM cameras
)
SELECT 'camera_id' AS "column", count(camera_id) AS present,
       count(*) FILTER (camera_id IS NOT NULL AND try_cast(camera_id AS BIGINT) IS NULL) AS unreadable FROM texts
UNION ALL SELECT 'equipment_id', count(equipment_id), 0 FROM texts
UNION ALL SELECT 'address', count(address), 0 FROM texts
UNION ALL SELECT 'latitude', count(latitude),
       count(*) FILTER (latitude IS NOT NULL AND try_cast(latitude AS DOUBLE) IS NULL) FROM texts
UNION ALL SELECT 'longitude', count(longitude),
       count(*) FILTER (longitude IS NOT NULL AND try_cast(longitude AS DOUBLE) IS NULL) FROM texts""",
        "event_facts_collated": f"{events} SELECT * FROM facts ORDER BY datetime DESC",
        "event_facts_from_state": f"{events} SELECT * FROM facts ORDER BY datetime DESC",
        "volume_facts_from_state": f"{volumes} SELECT * FROM facts ORDER BY datetime DESC",
        "event_total": f"{events} SELECT count(*) AS events FROM facts",
        "event_count_by_type": f"""{events}
SELECT event_type, count(camera_id) AS events FROM facts
WHERE event_type IS NOT NULL GROUP BY event_type""",
        "confidence_by_type": f"""{events}
SELECT event_type, avg(confidence) AS confidence,
       round_even(avg(confidence) * 100, 2) AS percent
FROM facts WHERE event_type IS NOT NULL AND confidence IS NOT NULL GROUP BY event_type""",
        "event_count_by_camera": _crosstab("camera_id", "camera_id IS NOT NULL"),
        "event_frequency_by_camera": f"""{events}
SELECT camera_id, count(*) AS events FROM facts GROUP BY camera_id ORDER BY events DESC""",
        "event_count_by_lane": f"""{events}
SELECT event_type, zone, count(camera_id) AS events FROM facts
WHERE event_type IS NOT NULL AND zone IS NOT NULL GROUP BY event_type, zone""",
        "event_lane_rollup": f"""{events}
SELECT event_type, zone, count(camera_id) AS events,
       CAST(grouping(event_type) + grouping(zone) AS INT) AS level
FROM facts WHERE event_type IS NOT NULL AND zone IS NOT NULL GROUP BY ROLLUP (event_type, zone)""",
        "lane_count_b2t": _crosstab("zone", "zone LIKE 'b2t%'", "ORDER BY k.zone DESC, t.event_type"),
        "lane_count_t2b": _crosstab("zone", "zone LIKE 't2b%'", "ORDER BY k.zone, t.event_type"),
        "confidence_by_type_item": f"""{events}
SELECT event_type, item_type, avg(confidence) AS confidence,
       round_even(avg(confidence) * 100, 2) AS percent
FROM facts WHERE event_type IS NOT NULL AND item_type IS NOT NULL AND confidence IS NOT NULL
GROUP BY event_type, item_type""",
        "hourly_confidence": f"""{events}, means AS (
  SELECT datetime, event_type, avg(confidence) AS y FROM facts
  WHERE event_type IS NOT NULL GROUP BY 1, 2 HAVING avg(confidence) IS NOT NULL
), hours AS (
  SELECT unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 HOUR)) AS datetime FROM means
), filled AS (
  SELECT h.datetime, k.event_type, m.y IS NULL AS gap,
         last_value(m.y IGNORE NULLS) OVER (PARTITION BY k.event_type ORDER BY h.datetime)
           AS confidence
  FROM hours h CROSS JOIN (SELECT DISTINCT event_type FROM means) k
       LEFT JOIN means m ON m.datetime = h.datetime AND m.event_type = k.event_type
)
SELECT datetime, event_type, confidence, gap,
       CASE WHEN count(confidence) OVER w = 3 THEN avg(confidence) OVER w END AS smoothed
FROM filled
WINDOW w AS (PARTITION BY event_type ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        "hourly_event_count_in": _hourly_counts("IN"),
        "hourly_event_count_out": _hourly_counts("OUT"),
        "volume_speed_metrics": f"""{volumes}
SELECT destination, CAST(min(car_count) AS BIGINT) AS min_car_count,
       CAST(trunc(avg(car_count)) AS BIGINT) AS mean_car_count,
       CAST(max(car_count) AS BIGINT) AS max_car_count,
       round_even(min(lane_speed), 2) AS min_lane_speed,
       round_even(avg(lane_speed), 2) AS mean_lane_speed,
       round_even(max(lane_speed), 2) AS max_lane_speed,
       round_even(min("LOS"), 4) AS "min_LOS", round_even(avg("LOS"), 4) AS "mean_LOS",
       round_even(max("LOS"), 4) AS "max_LOS"
FROM facts WHERE destination IS NOT NULL GROUP BY destination""",
        "los_heat_map": f"{heat_map} SELECT * FROM heat_map",
        "los_heat_map_scale": f"""{heat_map}
SELECT destination, avg(latitude) AS center_latitude, avg(longitude) AS center_longitude,
       min("LOS") AS "min_LOS", median("LOS") AS "median_LOS", max("LOS") AS "max_LOS"
FROM heat_map GROUP BY destination""",
        "hourly_vehicle_count": f"{hourly_totals} SELECT * FROM totals",
        "mean_hourly_car_count": f"{hourly_totals} SELECT avg(car) AS mean_car FROM totals",
        "hourly_los": f"{HOURLY_LOS} SELECT * FROM hourly",
        "los_thresholds": f"""{HOURLY_LOS}
SELECT destination, level, threshold, colour, count(*) FILTER ("LOS" >= threshold) AS hours
FROM hourly, (VALUES {lines}) AS t(level, threshold, colour)
GROUP BY destination, level, threshold, colour""",
        "hourly_los_band": f"""{HOURLY_LOS}
SELECT datetime, destination, "LOS", CAST({band} AS INT) AS band FROM hourly""",
        "los_split": f"{SPLIT} SELECT * FROM split",
        "los_model": f"{MODEL} SELECT * FROM model",
        "los_backtest": f"{BACKTEST} SELECT * FROM backtest",
        "los_forecast": FORECAST,
        "los_scores": f"{BACKTEST} {SCORES}",
        "camera_los_model": _by_camera(f"{MODEL} SELECT * FROM model"),
        "camera_los_forecast": _by_camera(FORECAST),
        "los_scores_observed": f"{BACKTEST} {SCORES_OBSERVED}",
        "camera_los_scores": _by_camera(f"""{BACKTEST}, scores AS ({SCORES_OBSERVED})
SELECT destination, n_test, n_zero, round_even(mape, 6) + CAST(0 AS DOUBLE) AS mape,
       round_even(rmse, 6) + CAST(0 AS DOUBLE) AS rmse FROM scores"""),
        "camera_los_rmse": _by_camera(f"""{BACKTEST}, scores AS ({SCORES})
SELECT destination, n_test, round_even(rmse, 6) AS rmse FROM scores"""),
        "los_stationarity": f"{STATIONARITY} SELECT * FROM choice",
        "camera_los_stationarity": _by_camera(f"{STATIONARITY} SELECT * FROM choice"),
        "camera_los_model_chosen_d": _by_camera(f"""{_by_order(chosen=True)}
SELECT destination, p, d, n_train, n_test, n, last_y, {', '.join(
    f"round_even({c}, 6) + CAST(0 AS DOUBLE) AS {c}"
    for c in ("intercept", "sigma", "aic", *(f"phi_{k}" for k in range(1, 6))))}
FROM model"""),
        "los_model_summary": _summary(),
        "los_model_chosen_d": f"""{_by_order(chosen=True)}
SELECT destination, p, d, n_train, n_test, n, last_y, intercept, sigma, aic, phi_1, phi_2, phi_3,
       phi_4, phi_5
FROM model""",
        "los_model_by_order": f"""{by_order}
SELECT destination, p, d, n_train, n_test, n, last_y, intercept, sigma, aic, phi_1, phi_2, phi_3,
       phi_4, phi_5
FROM model""",
        "los_backtest_by_order": f"{by_order} SELECT * FROM backtest",
        "los_forecast_by_order": f"""{by_order}
SELECT destination, datetime, y AS observed, CAST(NULL AS DOUBLE) AS forecast,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper
FROM split
UNION ALL
SELECT a.destination, s.datetime + INTERVAL 1 HOUR * CAST(a.position - s.hours AS INT), NULL,
       prediction, prediction - half, prediction + half
FROM predicted a JOIN split s ON a.destination = s.destination AND s.position = s.hours
WHERE a.position > s.hours""",
        "los_scores_by_order": f"{by_order} {SCORES}",
    }

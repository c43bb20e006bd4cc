"""SQL counterparts of the registered queries, for an independent engine over the same tables.

Means are computed on whole numbers (speeds in hundredths, frame means in tenths) and rounded half
away from zero by integer division, so that no comparison hangs on a binary tie.
"""

from __future__ import annotations

HOUR = 3_600_000
DAY = 86_400_000

POINTS = """
t AS (
  SELECT event_id, user_id AS vehicle_id, epoch_us(ts) // 1000 AS global_time,
         (user_id % 8 + 1)::INT AS lane_raw,
         (CASE WHEN user_id % 8 + 1 IN (7, 8) THEN 6 ELSE user_id % 8 + 1 END)::INT AS lane_id,
         (event_id % 60)::DOUBLE AS local_x, (event_id * 7919 % 2224)::DOUBLE AS local_y,
         sqrt((event_id % 60)::DOUBLE * (event_id % 60)
              + (event_id * 7919 % 2224)::DOUBLE * (event_id * 7919 % 2224)) AS distance,
         round(value * 100)::BIGINT AS vel, (event_id % 21 - 10) * 100 AS acc,
         event_type AS location
  FROM events)"""


def _mean(total: str, count: str) -> str:
    """Mean of whole numbers, rounded half away from zero to a whole number."""
    return (
        f"(sign({total})::BIGINT * ((2 * abs({total})::BIGINT + {count}) // (2 * {count})))"
    )


SECTIONS = f"""{POINTS},
sec AS (
  SELECT location, global_time - global_time % {HOUR} AS frame,
         trunc(distance / 247.0)::INT AS section_id, lane_id,
         (2 * sum(vel)::BIGINT + 10 * count(*)) // (20 * count(*)) AS vel,
         {_mean('sum(acc)::BIGINT', 'count(*)')} AS acc,
         count(*) AS n
  FROM t GROUP BY ALL)"""


def _windows(day: int = DAY, keep: str = "true", name: str = "win") -> str:
    return f"""
{name} AS (
  SELECT location, frame // {day} AS time_window, section_id, lane_id,
         {_mean('sum(vel)::BIGINT', 'count(*)')} AS vel,
         {_mean('sum(acc)::BIGINT', 'count(*)')} AS acc,
         count(*) AS n, sum(n)::BIGINT AS vehicles
  FROM sec WHERE {keep} GROUP BY ALL)"""


def _grid(lanes: int = 6, win: str = "win", name: str = "grid") -> str:
    return f"""
{name} AS (
  SELECT k.location, k.time_window, l.lane_id, s.section_id,
         coalesce(w.vel // 10, 60)::INT AS vel, coalesce(w.n, 0)::DOUBLE AS dens,
         coalesce(w.acc, 0) AS acc
  FROM (SELECT DISTINCT location, time_window FROM {win}) k
  CROSS JOIN (SELECT unnest(range(1, {lanes + 1}))::INT AS lane_id) l
  CROSS JOIN (SELECT unnest(range(0, 10))::INT AS section_id) s
  LEFT JOIN {win} w ON w.location = k.location AND w.time_window = k.time_window
       AND w.lane_id = l.lane_id AND w.section_id = s.section_id)"""


def _series(span: int, win: str = "win", name: str = "ser") -> str:
    """Rank of each window, and the number of samples of its site."""
    return f"""
{name} AS (
  SELECT location, time_window,
         row_number() OVER (PARTITION BY location ORDER BY time_window) - 1 AS idx,
         count(*) OVER (PARTITION BY location) - {span} AS num_samples
  FROM (SELECT DISTINCT location, time_window FROM {win}))"""


WINDOWS = f"{SECTIONS},{_windows()}"
GRID = f"{WINDOWS},{_grid()}"
WINDOW_COLUMNS = """location, time_window, section_id, lane_id, vel::DOUBLE / 10 AS avg_vel,
       acc::DOUBLE / 100 AS avg_acc, n, vehicles"""
SECTION_COLUMNS = """location, frame AS elapsed_time, section_id, lane_id,
       vel::DOUBLE / 10 AS avg_vel, acc::DOUBLE / 100 AS avg_acc, n"""


def _long_samples(skip: int, predict: int = 1) -> str:
    span, gap = 6 + skip + predict, 6 + skip
    return f"""WITH {GRID},{_series(span)},
starts AS (SELECT location, idx AS sample_id FROM ser WHERE idx < num_samples),
steps AS (
  SELECT location, sample_id, 'history' AS role, j AS step, sample_id + j AS idx
  FROM starts CROSS JOIN (SELECT unnest(range(0, 6))::INT AS j)
  UNION ALL
  SELECT location, sample_id, 'target', j AS step, sample_id + {gap} + j
  FROM starts CROSS JOIN (SELECT unnest(range(0, {predict}))::INT AS j))
SELECT steps.location, sample_id, role, step, grid.time_window, lane_id, section_id, vel, dens,
       acc::DOUBLE / 100 AS acc
FROM steps JOIN ser USING (location, idx)
JOIN grid ON grid.location = ser.location AND grid.time_window = ser.time_window"""


def _scored(
    h: int, k: int, grid: str = "grid", ser: str = "ser", prefix: str = "", predict: int = 1
) -> str:
    """Test samples with both baseline forecasts, one row per cell and target step."""
    gap = h + k
    return f"""
{prefix}starts AS (
  SELECT location, idx AS sample_id FROM {ser}
  WHERE idx < num_samples AND idx >= floor(0.8::DOUBLE * num_samples)),
{prefix}cell AS (SELECT location, idx, lane_id, section_id, vel
  FROM {grid} JOIN {ser} USING (location, time_window)),
{prefix}mean AS (
  SELECT b.location, sample_id, lane_id, section_id, sum(vel)::DOUBLE / {h} AS prediction
  FROM {prefix}starts b JOIN {prefix}cell c ON c.location = b.location
       AND c.idx >= sample_id AND c.idx < sample_id + {h}
  GROUP BY ALL),
{prefix}scored AS (
  SELECT m.location, m.sample_id, (y.idx - m.sample_id - {gap})::INT AS step, m.lane_id,
         m.section_id, p.vel::DOUBLE AS persistence, m.prediction AS history_mean,
         y.vel::DOUBLE AS actual
  FROM {prefix}mean m
  JOIN {prefix}cell p ON p.location = m.location AND p.idx = m.sample_id + {h - 1}
       AND p.lane_id = m.lane_id AND p.section_id = m.section_id
  JOIN {prefix}cell y ON y.location = m.location
       AND y.idx >= m.sample_id + {gap} AND y.idx < m.sample_id + {gap + predict}
       AND y.lane_id = m.lane_id AND y.section_id = m.section_id)"""


def _significant(expr: str, name: str) -> str:
    return f"printf('%.8e', {expr})::DOUBLE AS {name}"


def _metrics(model: str, columns: str, table: str = "scored", mse: bool = True) -> str:
    e = f"abs(actual - {model})"
    mape = f"avg({e} / greatest(abs(actual), 2.220446049250313e-16))"
    maape = (
        f"avg(CASE WHEN actual <> 0 THEN atan({e} / abs(actual)) "
        f"WHEN {e} = 0 THEN 0.0 ELSE pi() / 2 END)"
    )
    rows = [(f"avg({e} * {e})", "mse")] if mse else []
    rows += [(f"avg({e})", "mae"), (mape, "mape"), (maape, "maape")]
    rows += [(f"sqrt(avg({e} * {e}))", "rmse")]
    return f"SELECT {columns}, " + ", ".join(_significant(*r) for r in rows) + f" FROM {table}"


SCORED = f"{GRID},{_series(8)},{_scored(6, 1)}"


def _sweep() -> str:
    """Six parameter sets, two baselines each."""
    ctes = [SECTIONS]
    selects = []
    for seconds, half in ((86400, "d"), (43200, "h")):
        ctes.append(_windows(seconds * 1000, name=f"win_{half}"))
        for lanes in (6, 5):
            ctes.append(_grid(lanes, f"win_{half}", f"grid_{half}{lanes}"))
    for seconds, half, h, k in ((86400, "d", 6, 1), (86400, "d", 6, 2), (43200, "h", 12, 2)):
        ser = f"ser_{half}{k}"
        ctes.append(_series(h + k + 1, f"win_{half}", ser))
        for lanes, ramp in ((6, "w"), (5, "wo")):
            prefix = f"s_{half}{h}{k}{lanes}_"
            ctes.append(_scored(h, k, f"grid_{half}{lanes}", ser, prefix))
            for model in ("persistence", "history_mean"):
                name = f"'{model}_{ramp}_{seconds}_10_{h}_1_{k}' AS model_name"
                selects.append(_metrics(model, name, f"{prefix}scored"))
    return "WITH " + ",".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


def _eliminated(
    h: int, k: int, lams: tuple[float, ...], grid: str = "grid", ser: str = "ser", prefix: str = "",
    features: tuple[str, ...] = (),
) -> str:
    """Ridge of y ~ lags + cell per site and shrinkage, by removing one regressor after the other.

    Everything is centred by the cell's train means; each lag is then projected out of the later
    ones and of y with coefficients of the train rows. What is left of y is the residual. The
    penalty of a lag is one more train row, which has the root of it in that lag and 0 elsewhere.
    """
    lags = range(1, h + len(features) + 1)
    columns = ", ".join(
        [f"lead(vel::DOUBLE, {j - 1}) OVER o AS x{j}" for j in range(1, h + 1)]
        + [f"{f} AS x{h + j}" for j, f in enumerate(features, 1)]
    )
    centred = ", ".join(
        f"{c} - avg({c}) FILTER (WHERE train) OVER (PARTITION BY location, lane_id, section_id) AS {c}"
        for c in [f"x{j}" for j in lags] + ["y"]
    )
    keys = "location, sample_id, num_samples, lane_id, section_id, train, actual, lam"
    roots = ", ".join(f"CASE WHEN j = {j} THEN root ELSE 0 END AS x{j}" for j in lags)
    ctes = f"""
        {prefix}cell AS (SELECT location, idx, num_samples, lane_id, section_id, vel, dens, acc
                 FROM {grid} JOIN {ser} USING (location, time_window)),
        {prefix}wide AS (SELECT location, idx AS sample_id, num_samples, lane_id, section_id, {columns},
                        lead(vel::DOUBLE, {h + k}) OVER o AS y
                 FROM {prefix}cell WINDOW o AS (PARTITION BY location, lane_id, section_id ORDER BY idx)),
        {prefix}flagged AS (SELECT *, y AS actual, sample_id < floor(0.7::DOUBLE * num_samples) AS train
                    FROM {prefix}wide WHERE sample_id < num_samples),
        {prefix}lam AS (SELECT unnest([{", ".join(map(str, lams))}])::DOUBLE AS lam),
        {prefix}size AS (SELECT location, count(*) AS n FROM {prefix}flagged WHERE train GROUP BY ALL),
        {prefix}r0 AS MATERIALIZED (
          SELECT {keys}, {centred} FROM {prefix}flagged CROSS JOIN {prefix}lam WINDOW w AS (PARTITION BY lam)
          UNION ALL
          SELECT location, NULL, NULL, NULL, NULL, true, NULL, lam, {roots}, 0
          FROM (SELECT location, lam, j, sqrt(lam * n) AS root FROM {prefix}size CROSS JOIN {prefix}lam
                CROSS JOIN (SELECT unnest(range(1, {len(lags) + 1})) AS j)))"""
    ctes = ctes.replace("PARTITION BY location, lane_id, section_id) AS", "PARTITION BY lam, location, lane_id, section_id) AS")
    ctes = ctes.replace(" WINDOW w AS (PARTITION BY lam)", "")
    for j in lags:
        rest = [f"x{i}" for i in lags if i > j] + ["y"]
        slopes = ", ".join(f"sum(x{j} * {c}) / nullif(sum(x{j} * x{j}), 0) AS b_{c}" for c in rest)
        cleaned = ", ".join(f"{c} - x{j} * coalesce(b_{c}, 0) AS {c}" for c in rest)
        ctes += f""",
        {prefix}b{j} AS MATERIALIZED (
          SELECT location, lam, {slopes} FROM {prefix}r{j - 1} WHERE train GROUP BY ALL),
        {prefix}r{j} AS MATERIALIZED (
          SELECT {keys}, {cleaned} FROM {prefix}r{j - 1} JOIN {prefix}b{j} USING (location, lam))"""
    return ctes + f""",
        {prefix}fitted AS MATERIALIZED (
          SELECT location, sample_id, num_samples, lane_id, section_id, lam, actual - y AS prediction, actual
          FROM {prefix}r{len(lags)} WHERE sample_id IS NOT NULL)"""


def _least_squares(h: int, k: int, features: tuple[str, ...] = ()) -> str:
    """Test predictions without shrinkage."""
    return f"""WITH {GRID},{_series(h + k + 1)},{_eliminated(h, k, (0.0,), features=features)}
        SELECT location, sample_id, lane_id, section_id, round(prediction, 5) AS prediction, actual
        FROM fitted WHERE sample_id >= floor(0.8::DOUBLE * num_samples)"""


def _chosen(prefix: str) -> str:
    """Test rows of the shrinkage with the least validation error, per site."""
    return f"""
        {prefix}loss AS (
          SELECT location, lam, avg((actual - prediction) ** 2) AS loss FROM {prefix}fitted
          WHERE sample_id >= floor(0.7::DOUBLE * num_samples) AND sample_id < floor(0.8::DOUBLE * num_samples)
          GROUP BY ALL),
        {prefix}best AS (
          SELECT DISTINCT ON (f.location) f.location, f.lam
          FROM (SELECT DISTINCT location, lam FROM {prefix}fitted) f LEFT JOIN {prefix}loss l USING (location, lam)
          ORDER BY f.location, coalesce(loss, 'inf'::DOUBLE), f.lam),
        {prefix}tested AS (
          SELECT * FROM {prefix}fitted JOIN {prefix}best USING (location, lam)
          WHERE sample_id >= floor(0.8::DOUBLE * num_samples))"""


def _regression_sweep() -> str:
    """Six parameter sets, three shrinkages each."""
    ctes, selects = [SECTIONS], []
    for seconds, half in ((86400, "d"), (43200, "h")):
        ctes.append(_windows(seconds * 1000, name=f"win_{half}"))
        for lanes in (6, 5):
            ctes.append(_grid(lanes, f"win_{half}", f"grid_{half}{lanes}"))
    for seconds, half, h, k in ((86400, "d", 6, 1), (86400, "d", 6, 2), (43200, "h", 12, 2)):
        ser = f"ser_{half}{k}"
        ctes.append(_series(h + k + 1, f"win_{half}", ser))
        for lanes, ramp in ((6, "w"), (5, "wo")):
            prefix = f"f_{half}{h}{k}{lanes}_"
            ctes.append(_eliminated(h, k, (0.0, 0.01, 0.1), f"grid_{half}{lanes}", ser, prefix))
            ctes.append(_chosen(prefix))
            name = f"'regression_{ramp}_{seconds}_10_{h}_1_{k}' AS model_name"
            selects.append(_metrics("prediction", name, f"{prefix}tested"))
    return "WITH " + ",".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


def _descended(h: int = 6, k: int = 1, epochs: int = 10, patience: int = 2, rate: float = 0.05) -> str:
    """The iterative fit, one epoch after the other: errors ``log`` and ``tested`` rows by the best epoch."""
    lags = range(1, h + 1)
    scaled = ", ".join(
        f"(lead(vel::DOUBLE, {j - 1}) OVER o - 60) / 10 AS x{j}" for j in lags
    )
    guess = " + ".join(f"w{j} * x{j}" for j in lags)
    ctes = f"""
        cell AS (SELECT location, idx, num_samples, lane_id, section_id, vel
                 FROM grid JOIN ser USING (location, time_window)),
        wide AS (SELECT location, idx AS sample_id, num_samples, lane_id, section_id, {scaled},
                        lead(vel::DOUBLE, {h + k}) OVER o AS actual
                 FROM cell WINDOW o AS (PARTITION BY location, lane_id, section_id ORDER BY idx)),
        z AS MATERIALIZED (
          SELECT *, (actual - 60) / 10 AS y, sample_id < floor(0.7::DOUBLE * num_samples) AS train,
                 sample_id < floor(0.8::DOUBLE * num_samples) AS known
          FROM wide WHERE sample_id < num_samples),
        p0 AS (SELECT location, {", ".join(f"0::DOUBLE AS w{j}, 0::DOUBLE AS m{j}, 0::DOUBLE AS u{j}" for j in lags)}
               FROM z WHERE train GROUP BY location),
        c0 AS (SELECT DISTINCT location, lane_id, section_id, 0::DOUBLE AS b, 0::DOUBLE AS m, 0::DOUBLE AS u FROM z)"""
    losses = []
    for e in range(epochs + 1):
        step = rate / (1 - 0.9 ** (e + 1))
        gradients = ", ".join(f"-sum(r / root * x{j}) FILTER (train) / count(*) FILTER (train) AS g{j}" for j in lags)
        moved = ", ".join(
            f"0.9::DOUBLE * m{j} + 0.1::DOUBLE * g{j} AS m{j}, greatest(0.999::DOUBLE * u{j}, abs(g{j})) AS u{j}" for j in lags
        )
        weights = ", ".join(f"w{j} - {step!r}::DOUBLE * m{j} / (u{j} + 1e-8::DOUBLE) AS w{j}, m{j}, u{j}" for j in lags)
        ctes += f""",
        r{e} AS MATERIALIZED (
          SELECT *, sqrt(1 + r * r) AS root FROM (
            SELECT z.*, y - ({guess}) - b AS r FROM z JOIN p{e} USING (location)
            JOIN c{e} USING (location, lane_id, section_id))),
        l{e} AS MATERIALIZED (
          SELECT location, {e} AS epoch, avg(root - 1) FILTER (train) AS loss,
                 avg(root - 1) FILTER (known AND NOT train) AS val_loss, count(*) FILTER (train) AS cells, {gradients}
          FROM r{e} GROUP BY location),
        p{e + 1} AS MATERIALIZED (
          SELECT location, {weights} FROM (
            SELECT location, {", ".join(f"w{j}" for j in lags)}, {moved} FROM p{e} JOIN l{e} USING (location))),
        c{e + 1} AS MATERIALIZED (
          SELECT location, lane_id, section_id, b - {step!r}::DOUBLE * m / (u + 1e-8::DOUBLE) AS b, m, u FROM (
            SELECT location, lane_id, section_id, b, 0.9::DOUBLE * m + 0.1::DOUBLE * g AS m,
                   greatest(0.999::DOUBLE * u, abs(g)) AS u
            FROM c{e} JOIN (SELECT location, lane_id, section_id, -sum(r / root) FILTER (train) / any_value(cells) AS g
                            FROM r{e} JOIN l{e} USING (location) GROUP BY location, lane_id, section_id)
            USING (location, lane_id, section_id)))"""
        losses.append(f"SELECT location, epoch, loss, val_loss FROM l{e}")
    tests = " UNION ALL ".join(
        f"SELECT location, {e} AS epoch, sample_id, lane_id, section_id, actual, r FROM r{e} WHERE NOT known"
        for e in range(epochs + 1)
    )
    return f"""WITH {GRID},{_series(h + k + 1)},{ctes},
        losses AS ({" UNION ALL ".join(losses)}),
        marked AS (
          SELECT *, coalesce(val_loss < min(val_loss) OVER (
            PARTITION BY location ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better
          FROM losses),
        placed AS (
          SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY location ORDER BY epoch) AS best_epoch
          FROM marked),
        ends AS (
          SELECT location, min(epoch) AS last FROM placed
          WHERE epoch - best_epoch >= {patience} OR epoch = {epochs} GROUP BY location),
        log AS (
          SELECT location, epoch, loss, val_loss, best_epoch, epoch < last AS running
          FROM placed JOIN ends USING (location) WHERE epoch <= last),
        tested AS (
          SELECT t.* FROM ({tests}) t JOIN log ON log.location = t.location AND NOT running AND best_epoch = t.epoch)"""


def _gap_filled() -> str:
    return f"""WITH {WINDOWS},
        held AS (SELECT * FROM win WHERE time_window % 7 < 5),
        ends AS (SELECT location, min(time_window) AS a, max(time_window) AS b FROM held GROUP BY ALL),
        every AS (SELECT location, unnest(range(a, b + 1)) AS time_window FROM ends)
        SELECT e.location, e.time_window, e.time_window - a AS idx, b - a + 1 AS series_len,
               l.lane_id, s.section_id, coalesce(w.vel // 10, 60)::INT AS vel,
               coalesce(w.n, 0)::DOUBLE AS dens, coalesce(w.acc::DOUBLE / 100, 0) AS acc
        FROM every e JOIN ends USING (location)
        CROSS JOIN (SELECT unnest(range(1, 7))::INT AS lane_id) l
        CROSS JOIN (SELECT unnest(range(0, 10))::INT AS section_id) s
        LEFT JOIN held w ON w.location = e.location AND w.time_window = e.time_window
             AND w.lane_id = l.lane_id AND w.section_id = s.section_id"""


CONIC = """
zone AS (SELECT radians(36.5) AS p0, radians(-120.5) AS l0, radians(38 + 26 / 60.0) AS p1,
         radians(37 + 4 / 60.0) AS p2, 2000000.0::DOUBLE AS fe, 500000.0::DOUBLE AS fn,
         6378137.0::DOUBLE AS a, sqrt(2 / 298.257222101::DOUBLE - 1 / 298.257222101::DOUBLE ** 2) AS e),
m AS (SELECT *, cos(p1) / sqrt(1 - e * e * sin(p1) ** 2) AS m1,
      cos(p2) / sqrt(1 - e * e * sin(p2) ** 2) AS m2,
      tan(pi() / 4 - p1 / 2) * ((1 + e * sin(p1)) / (1 - e * sin(p1))) ** (e / 2) AS t1,
      tan(pi() / 4 - p2 / 2) * ((1 + e * sin(p2)) / (1 - e * sin(p2))) ** (e / 2) AS t2,
      tan(pi() / 4 - p0 / 2) * ((1 + e * sin(p0)) / (1 - e * sin(p0))) ** (e / 2) AS t0 FROM zone),
cone AS (SELECT *, ln(m1 / m2) / ln(t1 / t2) AS n FROM m),
scale AS (SELECT *, a * m1 / (n * t1 ** n) AS af FROM cone),
xy AS (SELECT *, (local_x + 6042000) * (1200 / 3937::DOUBLE) - fe AS dx,
       af * t0 ** n + fn - (local_y + 2133000) * (1200 / 3937::DOUBLE) AS dy FROM t CROSS JOIN scale),
it0 AS (SELECT *, (sqrt(dx * dx + dy * dy) / af) ** (1 / n) AS tt FROM xy),
it1 AS (SELECT *, pi() / 2 - 2 * atan(tt) AS phi1 FROM it0)"""


def _iterations() -> str:
    """Fixed-point iteration of the latitude, the textbook way."""
    steps = "".join(
        f",\nit{i + 1} AS (SELECT *, pi() / 2 - 2 * atan(tt * ((1 - e * sin(phi{i})) / "
        f"(1 + e * sin(phi{i}))) ** (e / 2)) AS phi{i + 1} FROM it{i})"
        for i in range(1, 8)
    )
    return CONIC + steps + (
        ",\ngeo AS (SELECT *, degrees(phi8) AS lat, degrees(atan2(dx, dy) / n + l0) AS lon FROM it8)"
    )


def _datum() -> str:
    """Seven parameters over Cartesian coordinates; the latitude comes back by iteration."""
    steps = "".join(
        f",\nb{i + 1} AS (SELECT *, atan2(z2 + ew * 6378137.0::DOUBLE / sqrt(1 - ew * sin(q{i}) ** 2) * sin(q{i}), p) AS q{i + 1} FROM b{i})"
        for i in range(6)
    )
    return f"""
par AS (SELECT -0.9956::DOUBLE AS dx0, 1.9013::DOUBLE AS dy0, 0.5215::DOUBLE AS dz0, radians(0.025915::DOUBLE / 3600) AS rx,
        radians(0.009426::DOUBLE / 3600) AS ry, radians(0.011599::DOUBLE / 3600) AS rz, 1 - 0.00062::DOUBLE / 1000000 AS sc,
        2 / 298.257223563::DOUBLE - 1 / 298.257223563::DOUBLE ** 2 AS ew),
g1 AS (SELECT event_id, radians(lat) AS f, radians(lon) AS l, a, e * e AS e2 FROM geo),
g2 AS (SELECT *, a / sqrt(1 - e2 * sin(f) ** 2) AS nn FROM g1),
g3 AS (SELECT *, nn * cos(f) * cos(l) AS x, nn * cos(f) * sin(l) AS y, nn * (1 - e2) * sin(f) AS z FROM g2),
g4 AS (SELECT *, dx0 + sc * (x - rz * y + ry * z) AS x2, dy0 + sc * (rz * x + y - rx * z) AS y2,
       dz0 + sc * (-ry * x + rx * y + z) AS z2 FROM g3 CROSS JOIN par),
b0 AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p, f AS q0 FROM g4){steps}
SELECT event_id, round(degrees(q6), 7) AS lat, round(degrees(atan2(y2, x2)), 7) AS lon FROM b6"""


LOCAL = "(to_timestamp(global_time / 1000.0) AT TIME ZONE 'America/Los_Angeles')"
CLOSED_AT = f"(SELECT max(global_time - global_time % {HOUR}) - {DAY} FROM t)"


def _stream_windows(keep: str = "true") -> str:
    """Stream windows: frame means are kept to six decimals and rounded per window only."""
    return f"""
sf AS (
  SELECT location, global_time - global_time % {HOUR} AS frame,
         trunc(distance / 247.0)::INT AS section_id, lane_id,
         (2 * sum(vel)::BIGINT * 10000 + count(*)) // (2 * count(*)) AS micro
  FROM t GROUP BY ALL),
sw AS (
  SELECT location, window_start, section_id, lane_id,
         (2 * sum(micro)::BIGINT + 100000 * count(*)) // (200000 * count(*)) AS vel
  FROM (SELECT *, frame // {DAY} * {DAY} AS window_start FROM sf WHERE {keep})
  WHERE window_start + {DAY} <= {CLOSED_AT} GROUP BY ALL)"""


STREAM_GRID = f"""{POINTS},{_stream_windows()},
sg AS (
  SELECT k.location, k.window_start, l.lane_id, s.section_id, coalesce(w.vel // 10, 60)::INT AS vel
  FROM (SELECT DISTINCT location, window_start FROM sw) k
  CROSS JOIN (SELECT unnest(range(1, 7))::INT AS lane_id) l
  CROSS JOIN (SELECT unnest(range(0, 10))::INT AS section_id) s
  LEFT JOIN sw w ON w.location = k.location AND w.window_start = k.window_start
       AND w.lane_id = l.lane_id AND w.section_id = s.section_id)"""


# Sites that are silent two days a week, and all their windows from the first one on.
FILLED_GRID = f"""{POINTS.replace("FROM events)", f"""FROM events
  WHERE (epoch_us(ts) // 1000 // {DAY} + length(event_type)) % 7 < 5)""")},{_stream_windows()},
every AS (
  SELECT location, unnest(range(first, last + 1, {DAY})) AS window_start
  FROM (SELECT location, min(window_start) AS first, {CLOSED_AT} - {DAY} AS last FROM sw GROUP BY location)),
sg AS (
  SELECT k.location, k.window_start, l.lane_id, s.section_id, coalesce(w.vel // 10, 60)::INT AS vel
  FROM every k
  CROSS JOIN (SELECT unnest(range(1, 7))::INT AS lane_id) l
  CROSS JOIN (SELECT unnest(range(0, 10))::INT AS section_id) s
  LEFT JOIN sw w ON w.location = k.location AND w.window_start = k.window_start
       AND w.lane_id = l.lane_id AND w.section_id = s.section_id)"""


def _histories(closed_at: str, grid: str = STREAM_GRID, windows: str = "sw") -> str:
    return f"""{grid},
hist AS (
  SELECT location, based_start, window_start,
         (row_number() OVER (PARTITION BY location, based_start ORDER BY window_start) - 1)::INT AS step,
         count(*) OVER (PARTITION BY location, based_start) AS steps
  FROM (SELECT location, window_start, window_start - j * {DAY} AS based_start
        FROM (SELECT DISTINCT location, window_start FROM {windows})
        CROSS JOIN (SELECT unnest(range(0, 6)) AS j))
  WHERE based_start + 6 * {DAY} <= {closed_at})"""


def _site_forecasts(model: str, sites: str = "'click', 'view'", ctes: str = "") -> str:
    """Forecasts by a ``model`` of the last two windows ``v0, v1`` of each history, in halves of a mile."""
    return f"""WITH {_histories(CLOSED_AT)}{ctes},
ends AS (
  SELECT hist.location, based_start, lane_id, section_id, any_value(steps) AS steps,
         max(vel) FILTER (WHERE step = steps - 1) AS v1, max(vel) FILTER (WHERE step = steps - 2) AS v0
  FROM hist JOIN sg ON sg.location = hist.location AND sg.window_start = hist.window_start
  WHERE hist.location IN ({sites}) GROUP BY hist.location, based_start, lane_id, section_id)
SELECT location, based_start AS global_time, based_start + 7 * {DAY} AS target_start, 0::INT AS step,
       lane_id, section_id, (CASE WHEN steps = 6 THEN round_even({model}, 0) ELSE 0 END)::INT AS prediction
FROM ends"""


EARLY = f"""(SELECT max(f) - {DAY} FROM (SELECT global_time - global_time % {HOUR} AS f FROM t)
  WHERE f < (SELECT (min(global_time - global_time % {HOUR}) + max(global_time - global_time % {HOUR})) // 2 FROM t))"""


HISTORY_ROWS = """SELECT hist.location, based_start, step, hist.window_start, lane_id, section_id, vel
FROM hist JOIN sg ON sg.location = hist.location AND sg.window_start = hist.window_start"""


def sql() -> dict[str, str]:
    w = f"WITH {POINTS}\n"
    local = f"{w[:-1]},{_iterations()}\n"
    doubles = "vel::DOUBLE / 100 AS v_vel, acc::DOUBLE / 100 AS v_acc"
    round6 = "round(distance, 6) AS distance"
    sweep_scored = f"WITH {SCORED}\n"
    out = {
        "clean_units": f"""{w}SELECT event_id, vel::DOUBLE / 100 / 1.46666667::DOUBLE AS v_vel,
            acc::DOUBLE / 100 / 1.46666667::DOUBLE AS v_acc FROM t""",
        "lane_merge": f"{w}SELECT event_id, location, lane_id FROM t WHERE location = 'click'",
        "distance_elapsed": f"""{w}SELECT event_id, location, {round6},
            global_time - min(global_time) OVER (PARTITION BY location) AS elapsed_time FROM t""",
        "local_time": f"""{w}SELECT event_id,
            strftime({LOCAL}, '%Y-%m-%d %H:%M:%S.%g') AS wall_clock, global_time FROM t""",
        "calendar_parts": f"""{w}SELECT event_id, day({LOCAL})::INT AS day, month({LOCAL})::INT AS month,
            hour({LOCAL})::INT AS hour, year({LOCAL})::INT AS year FROM t""",
        "reproject": f"{local}SELECT event_id, round(lat, 7) AS lat, round(lon, 7) AS lon FROM geo",
        "reproject_datum": f"{local[:-1]},{_datum()}",
        "hour_filter": f"""{local}SELECT location, global_time - 1000 AS elapsed_time,
            hour({LOCAL})::INT AS hour, {round6}, vehicle_id, lane_id, {doubles},
            round(lat, 6) AS lat, round(lon, 6) AS lon FROM geo WHERE hour({LOCAL}) IN (7, 8)""",
        "lane_filter": f"""{w}SELECT location, global_time AS elapsed_time, hour({LOCAL})::INT AS hour,
            {round6}, vehicle_id, lane_id, {doubles} FROM t WHERE lane_id = 6""",
        "snapshot": f"""{local}SELECT location, global_time - global_time % {HOUR} AS elapsed_time,
            {round6}, vehicle_id, lane_id, {doubles}, round(lat, 6) AS lat, round(lon, 6) AS lon
            FROM geo WHERE global_time - global_time % {HOUR} = 1705320000000""",
        "elapsed_range": f"""{w}SELECT event_id, global_time AS elapsed_time,
            global_time // {DAY} AS time_window FROM t
            WHERE global_time >= 1704499200000 AND global_time < 1705968000000""",
        "sql_view": f"""{w}SELECT location, lane_id, count(*) AS n, max(global_time) AS last_seen
            FROM t WHERE location = 'click' AND lane_id = 6 GROUP BY ALL""",
        "csv_roundtrip": f"""{w}SELECT vehicle_id::INT AS vehicle_id, global_time, local_x, local_y,
            {doubles}, lane_raw AS lane_id, location FROM t""",
        "trajectory_segments": f"""{w}SELECT * FROM (
            SELECT location, vehicle_id, global_time AS t0, round(distance, 6) AS d0,
                   lead(global_time) OVER o AS t1, round(lead(distance) OVER o, 6) AS d1,
                   vel::DOUBLE / 100 AS v_vel
            FROM t WINDOW o AS (PARTITION BY location, vehicle_id
                                ORDER BY global_time, distance, vel)) WHERE t1 IS NOT NULL""",
        "section_agg": f"WITH {SECTIONS}\nSELECT {SECTION_COLUMNS} FROM sec",
        "section_increments": f"WITH {SECTIONS}\nSELECT {SECTION_COLUMNS} FROM sec",
        "section_table": f"WITH {SECTIONS}\nSELECT {SECTION_COLUMNS} FROM sec",
        "timewindow_agg": f"WITH {WINDOWS}\nSELECT {WINDOW_COLUMNS} FROM win",
        "timewindow_agg_range": f"""WITH {SECTIONS},
            {_windows(DAY // 2, "frame >= 1704499245000 AND frame < 1705968000500 - 45")}
            SELECT {WINDOW_COLUMNS} FROM win""",
        "window_range": f"""WITH {WINDOWS}
            SELECT {WINDOW_COLUMNS} FROM win WHERE time_window BETWEEN 19727 AND 19738""",
        "section_snapshot": f"""WITH {SECTIONS}
            SELECT {SECTION_COLUMNS} FROM sec WHERE frame = 1705320000000""",
        "snapshot_grid": f"""WITH {SECTIONS}, one AS (
            SELECT *, frame AS time_window FROM sec
            WHERE frame = 1705320000000),{_grid(6, "one")}
            SELECT location, time_window AS elapsed_time, lane_id, section_id, vel, dens,
                   acc::DOUBLE / 100 AS acc FROM grid""",
        "speed_histogram": f"""{w}SELECT ((vel + 50) // 100)::DOUBLE AS speed, count(*) AS n
            FROM t WHERE location = 'click' AND lane_id = 1 GROUP BY ALL""",
        "hourly_counts": f"""{w}SELECT day({LOCAL})::INT AS day, month({LOCAL})::INT AS month,
            hour({LOCAL})::INT AS hour, year({LOCAL})::INT AS year, location, count(*) AS n
            FROM t GROUP BY ALL""",
        "extent": f"""{w}SELECT location, max(global_time) AS max_elapsed,
            round(max(distance), 6) AS max_dist FROM t GROUP BY ALL""",
        "first_last_row": f"""{w[:-1]}, r AS (
              SELECT location, global_time - global_time % {HOUR} AS f, lane_id, vehicle_id, event_id FROM t),
            n AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY f, lane_id, vehicle_id, event_id) AS a,
                         row_number() OVER (PARTITION BY location
                                            ORDER BY f DESC, lane_id DESC, vehicle_id DESC, event_id DESC) AS b FROM r)
            SELECT x.location, x.f AS first_elapsed_time, x.lane_id AS first_lane_id,
                   x.vehicle_id AS first_vehicle_id, x.event_id AS first_event_id,
                   y.f AS last_elapsed_time, y.lane_id AS last_lane_id,
                   y.vehicle_id AS last_vehicle_id, y.event_id AS last_event_id
            FROM n x JOIN n y USING (location) WHERE x.a = 1 AND y.b = 1""",
        "scale_stats": f"""WITH {WINDOWS}
            SELECT location, min(vel)::DOUBLE / 10 AS min_vel, max(vel)::DOUBLE / 10 AS max_vel,
                   min(acc)::DOUBLE / 100 AS min_acc, max(acc)::DOUBLE / 100 AS max_acc,
                   0::BIGINT AS min_n, max(n) AS max_n FROM win GROUP BY ALL""",
        "min_max_scaled": f"""WITH {WINDOWS}, s AS (
            SELECT location, min(vel) AS v0, max(vel) AS v1, min(acc) AS a0, max(acc) AS a1,
                   max(n) AS n1 FROM win GROUP BY ALL)
            SELECT location, time_window, section_id, lane_id,
                   round((vel - v0)::DOUBLE / nullif(v1 - v0, 0), 6) AS avg_vel,
                   round((acc - a0)::DOUBLE / nullif(a1 - a0, 0), 6) AS avg_acc,
                   round(n::DOUBLE / n1, 6) AS n, vehicles
            FROM win JOIN s USING (location)""",
        "dense_grid_long": f"""WITH {GRID}
            SELECT location, time_window, lane_id, section_id, vel, dens,
                   acc::DOUBLE / 100 AS acc FROM grid""",
        "dense_grid_no_ramp": f"""WITH {WINDOWS},{_grid(5)}
            SELECT location, time_window, lane_id, section_id, vel, dens,
                   acc::DOUBLE / 100 AS acc FROM grid""",
        "dense_grid_array": f"""WITH {GRID}
            SELECT location, time_window, string_agg(
                concat(vel * 100, ',', (dens * 100)::BIGINT, ',', acc), ','
                ORDER BY lane_id, section_id) AS hundredths FROM grid GROUP BY ALL""",
        "flat_cells": f"""WITH {GRID}
            SELECT location, time_window,
                   string_agg(vel::VARCHAR, ',' ORDER BY lane_id, section_id) AS vel,
                   string_agg(dens::BIGINT::VARCHAR, ',' ORDER BY lane_id, section_id) AS dens,
                   string_agg(acc::VARCHAR, ',' ORDER BY lane_id, section_id) AS acc
            FROM grid GROUP BY ALL""",
        "series_rank": f"""WITH {WINDOWS},{_series(0)}
            SELECT location, time_window, idx, num_samples AS series_len FROM ser""",
        "samples_long": _long_samples(1),
        "samples_skip2": _long_samples(2),
        "samples_predict2": _long_samples(1, 2),
        "series_gap_fill": _gap_filled(),
        "chrono_split_bounded": f"""WITH {SECTIONS},
            {_windows(DAY, f"frame >= 1704412800000 AND frame < 1704412800000 + 20 * {DAY} - 45")},
            {_series(0).strip()}, cut AS (
              SELECT location, idx, time_window, least(num_samples, 15) - 8 AS num_samples FROM ser)
            SELECT a.location, a.idx AS sample_id, a.num_samples, a.time_window AS history_start,
                   b.time_window AS target_window,
                   CASE WHEN a.idx < floor(0.7::DOUBLE * a.num_samples) THEN 'train'
                        WHEN a.idx < floor(0.8::DOUBLE * a.num_samples) THEN 'validation'
                        ELSE 'test' END AS split
            FROM cut a JOIN cut b ON b.location = a.location AND b.idx = a.idx + 7
            WHERE a.idx < a.num_samples""",
        "chrono_split": f"""WITH {WINDOWS},{_series(8)}
            SELECT a.location, a.idx AS sample_id, a.num_samples, a.time_window AS history_start,
                   b.time_window AS target_window,
                   CASE WHEN a.idx < floor(0.7::DOUBLE * a.num_samples) THEN 'train'
                        WHEN a.idx < floor(0.8::DOUBLE * a.num_samples) THEN 'validation'
                        ELSE 'test' END AS split
            FROM ser a JOIN ser b ON b.location = a.location AND b.idx = a.idx + 7
            WHERE a.idx < a.num_samples""",
        "realtime_split": f"""WITH {WINDOWS},{_series(8)}
            SELECT location, idx AS sample_id,
                   CASE WHEN idx < floor(0.875::DOUBLE * num_samples) THEN 'train'
                        ELSE 'validation' END AS split
            FROM ser WHERE idx < num_samples""",
        "forecast_persistence": f"""{sweep_scored}SELECT location, sample_id, 0::INT AS step, lane_id,
            section_id, persistence AS prediction, actual FROM scored""",
        "forecast_udf": f"""{sweep_scored}SELECT location, sample_id, 0::INT AS step, lane_id,
            section_id, persistence AS prediction, actual FROM scored""",
        "forecast_history_mean": f"""{sweep_scored}SELECT location, sample_id, 0::INT AS step, lane_id,
            section_id, round(history_mean, 6) AS prediction, actual FROM scored""",
        "forecast_metrics": sweep_scored
        + "\nUNION ALL\n".join(
            _metrics(m, f"location, '{m}' AS model_name") + " GROUP BY location"
            for m in ("persistence", "history_mean")
        ),
        "forecast_regression_lags": _least_squares(6, 1),
        "forecast_regression_lag1": _least_squares(1, 1),
        "forecast_regression_features": _least_squares(1, 1, ("dens", "acc::DOUBLE / 100")),
        "forecast_regression_predict2": f"""WITH {GRID},{_series(4)},
            {_eliminated(1, 1, (0.0,), prefix="s0_").strip()},
            {_eliminated(1, 2, (0.0,), prefix="s1_").strip()}
            SELECT location, sample_id, step, lane_id, section_id, round(prediction, 5) AS prediction, actual
            FROM (SELECT *, 0::INT AS step FROM s0_fitted UNION ALL SELECT *, 1::INT FROM s1_fitted)
            WHERE sample_id >= floor(0.8::DOUBLE * num_samples)""",
        "forecast_regression": _regression_sweep(),
        "forecast_with_truth": f"""{sweep_scored}SELECT location, sample_id, step, lane_id,
            section_id, persistence AS prediction, actual FROM scored""",
        "forecast_metrics_predict2": f"WITH {GRID},{_series(9)},{_scored(6, 1, predict=2)}\n"
        + "\nUNION ALL\n".join(
            _metrics(m, f"location, '{m}' AS model_name, step") + " GROUP BY location, step"
            for m in ("persistence", "history_mean")
        ),
        "experiment_sweep": _sweep(),
        "metrics_log": sweep_scored
        + "\nUNION ALL\n".join(
            _metrics(m, f"'{m}' AS model_name", mse=False)
            for m in ("persistence", "history_mean")
        ),
        "frames_roundtrip": f"""{w}SELECT global_time - global_time % {HOUR} AS global_time,
            vehicle_id, local_x, local_y, {doubles}, lane_id, location FROM t""",
        "frame_messages": f"""{w[:-1]}, f AS (SELECT global_time - global_time % {HOUR} AS f FROM t)
            SELECT g AS global_time, count(f.f) AS points
            FROM (SELECT unnest(generate_series(min(f), max(f), {HOUR})) AS g FROM f) c
            LEFT JOIN f ON f.f = c.g GROUP BY ALL""",
        "stream_section_agg": f"""{w[:-1]},{_stream_windows()}
            SELECT location, frame, section_id, lane_id, micro::DOUBLE / 1000000 AS avg_vel
            FROM sf WHERE frame <= {CLOSED_AT}""",
        "stream_timewindow": f"""{w[:-1]},{_stream_windows()}
            SELECT location, window_start, section_id, lane_id, vel::DOUBLE / 10 AS avg_vel
            FROM sw""",
        "stream_dedup": f"""{w}SELECT location, vehicle_id, global_time,
            vel::DOUBLE / 100 AS v_vel FROM t
            WHERE global_time <= (SELECT max(global_time) - {DAY} FROM t)""",
        "stream_late_data": f"""{w[:-1]}, mid AS (
            SELECT (min(global_time - global_time % {HOUR})
                    + max(global_time - global_time % {HOUR})) // 2 AS middle FROM t),
            {_stream_windows("frame >= (SELECT middle FROM mid)")}
            SELECT location, window_start, section_id, lane_id, vel::DOUBLE / 10 AS avg_vel
            FROM sw""",
        "stream_matrix": f"""WITH {STREAM_GRID}
            SELECT location, window_start, lane_id, section_id, vel FROM sg""",
        "stream_history": f"WITH {_histories(CLOSED_AT)}\n{HISTORY_ROWS}",
        "stream_forecast": f"""WITH {_histories(CLOSED_AT)}
            SELECT hist.location, based_start AS global_time,
                   based_start + 7 * {DAY} AS target_start, lane_id, section_id,
                   (CASE WHEN steps = 6 THEN vel ELSE 0 END)::INT AS prediction
            FROM hist JOIN sg ON sg.location = hist.location
                 AND sg.window_start = hist.window_start
            WHERE step = steps - 1""",
        "stream_json_forecast": "WITH "
        + _histories(f"(SELECT max(window_start) - 6 * {DAY} FROM sw)")
        + f"""
            SELECT hist.location, based_start AS global_time, based_start + 7 * {DAY} AS target_start,
                   0::INT AS step, lane_id, section_id,
                   (CASE WHEN any_value(steps) = 6 THEN round_even(avg(vel), 0) ELSE 0 END)::INT AS prediction
            FROM hist JOIN sg ON sg.location = hist.location AND sg.window_start = hist.window_start
            WHERE hist.step >= steps - 2 GROUP BY hist.location, based_start, lane_id, section_id""",
        "stream_site_forecast": _site_forecasts(
            "CASE WHEN location = 'click' THEN v1 ELSE (v0 + v1) / 2.0::DOUBLE + 3 END"
        ),
        "stream_unmodelled": f"""WITH {_histories(CLOSED_AT)}
            SELECT location, count(DISTINCT based_start) AS histories FROM hist
            WHERE location NOT IN ('click', 'view') GROUP BY location""",
        "stream_model_refresh": _site_forecasts(
            f"""CASE WHEN based_start + 6 * {DAY} <= (SELECT done FROM early)
                     THEN v1 + CASE WHEN location = 'click' THEN 0 ELSE 1 END
                     WHEN location = 'click' THEN v1 + 5 ELSE (v0 + v1) / 2.0::DOUBLE END""",
            ctes=f", early AS (SELECT {EARLY} AS done)",
        ),
        "descent_epochs": f"""{_descended()}
            SELECT location, epoch, round(loss, 6) AS loss, round(val_loss, 6) AS val_loss, best_epoch, running
            FROM log""",
        "descent_forecast": f"""{_descended()}
            SELECT location, sample_id, lane_id, section_id, round(actual - 10 * r, 5) AS prediction, actual
            FROM tested""",
        "stream_late_count": f"""WITH {WINDOWS},
            arrived AS (SELECT DISTINCT location, time_window FROM win),
            ends AS (SELECT min(time_window) AS a, max(time_window) AS b FROM arrived)
            SELECT count(*) AS dropped FROM arrived CROSS JOIN ends
            WHERE time_window < b - 9 AND time_window <= b - 6""",
        "stream_gap_fill": f"""WITH {FILLED_GRID}
            SELECT location, window_start, lane_id, section_id, vel FROM sg""",
        "stream_gap_history": "WITH "
        + _histories(f"(SELECT max(window_start) - 6 * {DAY} FROM every)", FILLED_GRID, "every")
        + f"\n{HISTORY_ROWS}",
        "stream_ordered_publish": f"""{w[:-1]},{_stream_windows()}
            SELECT location, window_start, section_id, lane_id, vel::DOUBLE / 10 AS avg_vel
            FROM sw""",
        "stream_two_stage": "WITH "
        + _histories(f"(SELECT max(window_start) - 6 * {DAY} FROM sw)")
        + f"\n{HISTORY_ROWS}",
    }
    return out

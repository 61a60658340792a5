"""Linear systems in the check SQL: normal equations and their solution by
Gauss-Jordan elimination on lists."""

from .oracle_base import register


def register_sums(name, rows, needs, series="NULL"):
    """``name``: (series, p, m), m being the (p+1) x (p+1) list of lists of the sums of
    w * z_i * z_j; ``rows`` selects (``s``, ``z`` list, ``w``), z ending with the response."""
    register(name, f"""
  SELECT s, len(any_value(row)) - 1 AS p, list(row ORDER BY i) AS m FROM (
    SELECT s, i, list(v ORDER BY j) AS row FROM (
      SELECT s, i, j, sum(w * z[i] * z[j]) AS v FROM ({rows}) t,
        (SELECT unnest(range(1, 200)) AS i) a, (SELECT unnest(range(1, 200)) AS j) b
      WHERE i <= len(z) AND j <= len(z) GROUP BY s, i, j)
    GROUP BY s, i) GROUP BY s""", needs)


def register_solution(name, systems, needs):
    """``name``: (s, beta) for ``systems`` (s, a, b): a symmetric positive definite list
    of lists; a row of zeros has the solution 0."""
    register(name, f"""
  SELECT s, list_transform(m, lambda r: r[len(r)]) AS beta FROM (
    WITH RECURSIVE e AS (
      SELECT s, 1 AS k, len(b) AS p, list_transform(a, lambda r, i: list_append(
        list_transform(r, lambda v, j: CASE WHEN i = j AND v = 0 THEN 1 ELSE v END), b[i])) AS m FROM ({systems})
      UNION ALL
      SELECT s, k + 1, p, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
        ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM e WHERE k <= p)
    SELECT s, m FROM e WHERE k = p + 1)""", needs)


def register_forecast(name, days, needs):
    """CTEs of a forecast fitted on ``days`` (a kpi-like relation): ``{name}_place``
    (first, span, knots), ``{name}_fit`` (beta, sigma, bend)."""
    known = f"""
    SELECT full_date AS ds, orders AS y, precipitation_mm AS mm, temp_mean_c AS tc, coalesce(is_rainy::INT, 0) AS rain,
      coalesce(is_public_holiday::INT, 0) AS ph, coalesce(is_school_holiday::INT, 0) AS sh FROM ({days})"""
    register(f"{name}_day", f"SELECT * FROM ({known}) WHERE y > 0 AND mm IS NOT NULL AND tc IS NOT NULL", needs)
    register(f"{name}_place", f"""
  SELECT first, span, list_transform(q, lambda x: (x - (first - DATE '1970-01-01')) / span) AS knots FROM (
    SELECT min(ds) AS first, greatest(max(ds) - min(ds), 1)::DOUBLE AS span,
      quantile_cont((ds - DATE '1970-01-01')::DOUBLE, [{', '.join(f'0.8 * {k} / 25' for k in range(1, 26))}]) AS q
    FROM {name}_day)""", [f"{name}_day"])
    register_sums(f"{name}_sums", f"SELECT NULL AS s, list_append({design_sql('d', 'c')}, ln(y)) AS z, 1.0 AS w "
                                  f"FROM {name}_day d, {name}_place c", [f"{name}_day", f"{name}_place"])
    # the plain fit gives the noise that the bends are held against
    register_solution(f"{name}_plain", f"SELECT s, list_transform(m[:13], lambda r: r[:13]) AS a, list_transform(m[:13], "
                                       f"lambda r: r[39]) AS b FROM {name}_sums", [f"{name}_sums"])
    register(f"{name}_noise", f"""
  SELECT NULL AS s, (m[39][39] - list_sum(list_transform(beta, lambda v, i: v * m[i][39]))) / (m[1][1]
    - len(list_filter(m[:13], lambda r, i: r[i] > 0))) AS noise FROM {name}_plain JOIN {name}_sums ON TRUE""",
             [f"{name}_plain", f"{name}_sums"])
    # each fit gives the noise of the next one
    for k in range(1, 4):
        sums, noise = f"{name}_sums", f"{name}_noise" if k == 1 else f"{name}_noise{k}"
        full = ("list_transform(m[:38], lambda r, i: list_transform(r[:38], lambda v, j: "
                "CASE WHEN i = j AND i > 13 THEN v + noise / 0.005 ELSE v END))")
        register_solution(f"{name}_beta{k}", f"SELECT u.s, {full} AS a, list_transform(m[:38], lambda r: r[39]) AS b "
                                             f"FROM {sums} u, {noise}", [sums, noise])
        # degrees of freedom: the trace of the penalised inverse times the sums, a column each
        register_solution(f"{name}_columns{k}", f"SELECT k AS s, {full} AS a, list_transform(m[:38], lambda r: r[k]) AS b "
                                                f"FROM {sums}, {noise}, (SELECT unnest(range(1, 39)) AS k)", [sums, noise])
        register(f"{name}_noise{k + 1}", f"""
  SELECT NULL AS s, beta, greatest(m[39][39] - 2 * list_sum(list_transform(beta, lambda v, i: v * m[i][39]))
      + list_sum(list_transform(beta, lambda v, i: v * list_sum(list_transform(beta, lambda u, j: u * m[i][j])))), 0)
    / greatest(m[1][1] - used, 1) AS noise
  FROM {name}_beta{k}, {sums}, (SELECT sum(beta[s]) AS used FROM {name}_columns{k})""",
                 [f"{name}_beta{k}", sums, f"{name}_columns{k}"])
    register(f"{name}_fit", f"""
  SELECT beta, sqrt(noise) AS sigma, list_sum(list_transform(beta[14:], lambda v: abs(v))) / 25 AS bend
  FROM {name}_noise4""", [f"{name}_noise4"])


def design_sql(day, place):
    """The design of a forecast day: 13 terms, then 25 bends."""
    t = f"(({day}.ds - {place}.first) / {place}.span)"
    dummies = ", ".join(f"(isodow({day}.ds) = {d + 1})::INT::DOUBLE" for d in range(1, 7))
    return (f"list_concat([1.0::DOUBLE, {t}, {day}.mm, {day}.tc, {day}.rain, {day}.ph, {day}.sh, {dummies}], "
            f"list_transform({place}.knots, lambda k: greatest({t} - k, 0)))")


def drawn_sql(*parts):
    """The uniform draw of the same integer parts."""
    first = "((x + p + 1) * 1103515245) % 4294967296"
    second = f"(xor({first}, ({first}) >> 15) * 1812433253) % 4294967296"
    return (f"(list_reduce([0::BIGINT, {', '.join(f'{p}::BIGINT' for p in parts)}], "
            f"lambda x, p: xor({second}, ({second}) >> 16)) + 0.5) / 4294967296.0")


def register_predictions(name, fit, days, needs):
    """``name``: yhat and its interval for ``days`` (ds, mm, tc, rain, ph, sh, ...)."""
    macro = lambda *parts: drawn_sql(*parts)
    register(f"{name}_draw", f"""
  SELECT m, j, {macro(1, 1, 'm', 'j')} AS u, ln({macro(1, 2, 'm', 'j')}) * CASE WHEN {macro(1, 3, 'm', 'j')} < 0.5
      THEN 1 ELSE -1 END AS change, sqrt(-2 * ln({macro(1, 4, 'm', 'j')})) * cos({macro(1, 5, 'm', 'j')}
      * 6.283185307179586) AS noise
  FROM (SELECT unnest(range(1, 402)) AS m), (SELECT unnest(range(0, 60)) AS j)""")
    register(f"{name}_spread", f"""
  SELECT h, list_sort(list(v)) AS draws FROM (
    SELECT h, d.m, any_value(noise) * any_value(sigma) + coalesce(sum(change * bend * (h - e.j) / span)
        FILTER (WHERE e.u < 25 / (span * 0.8)), 0) AS v
    FROM (SELECT h, d.m, d.noise FROM (SELECT DISTINCT greatest(ds - first - span, 0)::INT AS h FROM ({days}), {fit}_place)
          JOIN {name}_draw d ON d.j = h) d
    LEFT JOIN (SELECT m, j, u, change FROM {name}_draw WHERE j >= 1) e ON e.m = d.m AND e.j < d.h, {fit}_place, {fit}_fit
    GROUP BY h, d.m) GROUP BY h""", [*needs, f"{fit}_place", f"{fit}_fit", f"{name}_draw"])
    register(name, f"""
  SELECT d.*, exp(log) AS yhat, exp(log + draws[41]) AS yhat_lower, exp(log + draws[361]) AS yhat_upper FROM (
    SELECT d.*, list_sum(list_transform({design_sql('d', 'c')}, lambda v, i: v * beta[i])) AS log,
      greatest(ds - first - span, 0)::INT AS h FROM ({days}) d, {fit}_place c, {fit}_fit) d JOIN {name}_spread USING (h)""",
             [f"{fit}_place", f"{fit}_fit", f"{name}_spread"])

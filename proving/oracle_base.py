"""Shared SQL for the checks: the star schema re-derived in plain SQL, and
text helpers for exact half-up ratios on integers."""

from martloom import fixed_values as V


def _names(expr, names):
    return f"[{', '.join(repr(n) for n in names)}][{expr}]"


def ratio(num_cents, den_cents, scale=1, places=2):
    """round-half-up(num*scale/den, places) on integers, NULL for den = 0."""
    k = scale * 10 ** places
    n, d = f"(CAST({num_cents} AS HUGEINT) * {k})", f"CAST({den_cents} AS HUGEINT)"
    up = f"((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
    return (f"(CASE WHEN {d} = 0 THEN NULL WHEN ({n} < 0) <> ({d} < 0) "
            f"THEN CAST(-{up} AS DOUBLE) ELSE CAST({up} AS DOUBLE) END"
            f" / {10 ** places}.0::DOUBLE)")


def eur(cents):
    """Integer cents as a double."""
    return f"(CAST({cents} AS DOUBLE) / 100.0::DOUBLE)"


def r3(product, unit):
    """Half-up division of a non-negative integer product by ``unit``."""
    return f"((2 * ({product}) + {unit}) // (2 * {unit}))"


_RAIN, _COLD = 200, 5.0

CTES = {
    "days": """
  SELECT CAST(d AS DATE) AS full_date, (CAST(d AS DATE) - DATE '1970-01-01') AS u
  FROM (SELECT unnest(generate_series(
          (SELECT min(CAST(o_orderdate AS DATE)) FROM orders)::TIMESTAMP,
          (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)::TIMESTAMP,
          INTERVAL 1 DAY)) AS d)""",
    "weather": """
  SELECT full_date, u,
    CASE WHEN u % 29 <> 0 THEN (u * 13 % 25) + 0.5::DOUBLE END AS temp_raw,
    CASE WHEN u % 29 <> 0 THEN u * 31 % 17 * 60 END AS mm_raw,
    CAST(u * 7 % 40 + 5 AS DOUBLE) AS wind_max_kmh FROM days""",
    "filled": """
  SELECT full_date, wind_max_kmh,
    last_value(temp_raw IGNORE NULLS) OVER w AS temp_mean_c,
    last_value(mm_raw IGNORE NULLS) OVER w AS mm
  FROM weather WINDOW w AS (ORDER BY full_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "school": """
  SELECT DISTINCT CAST(x AS DATE) AS full_date FROM (
    SELECT unnest(generate_series(s, e, INTERVAL 1 DAY)) AS x FROM (
      SELECT make_date(y, 7, 9)::TIMESTAMP AS s, make_date(y, 8, 22)::TIMESTAMP AS e
      FROM (SELECT DISTINCT year(full_date) AS y FROM days)
      UNION ALL
      SELECT make_date(y, 12, 22)::TIMESTAMP, make_date(y + 1, 1, 2)::TIMESTAMP
      FROM (SELECT DISTINCT year(full_date) AS y FROM days)))""",
    "cal": f"""
  SELECT CAST(strftime(d.full_date, '%Y%m%d') AS INTEGER) AS date_key, d.full_date, d.u,
    CAST(year(d.full_date) AS INTEGER) AS year, CAST(quarter(d.full_date) AS INTEGER) AS quarter,
    CAST(month(d.full_date) AS INTEGER) AS month,
    {_names('month(d.full_date)', V.MONTHS_EN)} AS month_name,
    {_names('month(d.full_date)', V.MONTHS_DE)} AS month_name_de,
    CAST(weekofyear(d.full_date) AS INTEGER) AS iso_week,
    CAST(day(d.full_date) AS INTEGER) AS day_of_month,
    CAST(isodow(d.full_date) AS INTEGER) AS day_of_week,
    {_names('isodow(d.full_date)', V.DAYS_EN)} AS day_name,
    {_names('isodow(d.full_date)', V.DAYS_DE)} AS day_name_de,
    isodow(d.full_date) >= 6 AS is_weekend,
    d.u % 30 = 0 AS is_public_holiday,
    CASE WHEN d.u % 30 = 0 THEN 'Holiday ' || (d.u % 7) END AS holiday_name,
    d.full_date IN (SELECT full_date FROM school) AS is_school_holiday,
    f.temp_mean_c, f.temp_mean_c + 6 AS temp_max_c, {eur('f.mm')} AS precipitation_mm,
    f.wind_max_kmh, coalesce(f.mm > {_RAIN}, FALSE) AS is_rainy,
    coalesce(f.temp_mean_c < {_COLD}, FALSE) AS is_cold
  FROM days d LEFT JOIN filled f USING (full_date)""",
    "channel": "\n  SELECT * FROM (VALUES " + ", ".join(
        f"({k}, '{n}', {str(a).upper()}, {int(r * 100)})" for k, n, a, r in V.CHANNELS)
        + ") AS t(channel_key, channel_name, is_aggregator, rate_pct)",
    "zone": """
  SELECT CAST(n_nationkey AS BIGINT) + 1 AS zone_key, CAST(n_nationkey + 14467 AS VARCHAR) AS plz,
    n_name AS district_name, 1 + n_nationkey * 7 % 10 AS km,
    (1 + n_nationkey * 7 % 10) * 50 AS fee_c FROM nation""",
    "item": """
  SELECT p_partkey AS item_key, p_name AS item_name, p_type AS category,
    CASE p_size % 4 WHEN 1 THEN 'small' WHEN 2 THEN 'normal' WHEN 3 THEN 'large' END AS size_name,
    CAST(round(p_retailprice * 100) AS BIGINT) AS price_c,
    (CAST(round(p_retailprice * 100) AS BIGINT) * 3 + 5) // 10 AS cost_c,
    p_size % 2 = 0 AS is_vegetarian FROM part""",
    "cust": """
  SELECT c_custkey AS customer_key, c_name AS customer_code,
    CAST(c_nationkey AS BIGINT) + 1 AS zone_key, c_mktsegment AS signup_channel FROM customer""",
    "line": """
  SELECT l_orderkey AS order_key, l_partkey AS item_key, CAST(l_quantity AS BIGINT) AS quantity,
    rev_c, (rev_c * 3 + 5) // 10 AS cost_c, (rev_c * pct + 50) // 100 AS disc_c
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS rev_c,
               CAST(round(l_discount * 100) AS BIGINT) AS pct FROM lineitem)""",
    "head": """
  SELECT o_orderkey AS order_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
    CAST(o_orderdate AS DATE) AS full_date,
    CAST(o_orderdate AS DATE)::TIMESTAMP + to_minutes(660 + o_orderkey * 7919 % 720) AS order_ts,
    o_custkey AS customer_key, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS channel_key,
    o_orderpriority[1] <> '5' AS is_delivery,
    CASE WHEN o_orderpriority[1] <> '5' THEN o_custkey % 25 + 1 END AS zone_key,
    CASE WHEN o_orderpriority[1] <> '5' THEN o_orderkey % 6 + 1 END AS driver_key,
    o_orderkey % 67 = 0 AS is_cancelled,
    CASE WHEN o_orderkey % 10 = 0 THEN '2FOR1' END AS promo_code FROM orders""",
    "ord": """
  SELECT *, 45 < actual_min AS is_late, rev_net0 - comm_c AS net_c,
    CASE WHEN hour(order_ts) < 11 THEN NULL WHEN hour(order_ts) < 14 THEN 'Mittag'
         WHEN hour(order_ts) < 17 THEN 'Nachmittag' WHEN hour(order_ts) < 21 THEN 'Abend'
         ELSE 'Spaet' END AS daypart
  FROM (SELECT *, (rate_pct * (gross_c - disc_c) + 50) // 100 AS comm_c,
          gross_c - disc_c + fee_c AS rev_net0
        FROM (SELECT h.*, coalesce(t.gross_c, 0) AS gross_c, coalesce(t.food_c, 0) AS food_c,
                coalesce(t.disc_c, 0) AS disc_c, coalesce(t.qty, 0) AS item_qty,
                c.rate_pct, coalesce(z.fee_c, 0) AS fee_c,
                CAST(15 + (h.order_key * 37 + h.zone_key * 11) % 50 AS INTEGER) AS actual_min
              FROM head h
              LEFT JOIN (SELECT order_key, CAST(sum(rev_c) AS BIGINT) AS gross_c,
                           CAST(sum(cost_c) AS BIGINT) AS food_c,
                           CAST(sum(disc_c) AS BIGINT) AS disc_c,
                           CAST(sum(quantity) AS BIGINT) AS qty
                         FROM line GROUP BY order_key) t USING (order_key)
              LEFT JOIN channel c USING (channel_key)
              LEFT JOIN zone z ON z.zone_key = h.zone_key))""",
    "assume": "\n  SELECT * FROM (VALUES " + ", ".join(
        [f"('{i}', 'fix', {float(m)}::DOUBLE, NULL::DOUBLE, '{i}')"
         for i, m in V.FIXED_COSTS_MONTHLY]
        + [f"('{i}', 'variabel', NULL, {float(r)}, '{i} ({b})')"
           for i, r, b in V.VARIABLE_COST_RATES])
        + ") AS t(cost_item, cost_type, monthly_eur, pct_of_revenue, note)",
    "hrs": f"""
  SELECT date_key, n, trips, gross_c, net_c, 1400 + n * 21 AS kitchen_h, 400 + trips * 25 AS driver_h,
    {r3("food_c * (10 + (full_date - DATE '1970-01-01') % 26)", 1000)} AS waste_c
  FROM (SELECT o.date_key, count(*) AS n, count(*) FILTER (WHERE is_delivery) AS trips,
          CAST(sum(food_c) AS BIGINT) AS food_c, CAST(sum(gross_c) AS BIGINT) AS gross_c,
          CAST(sum(net_c) AS BIGINT) AS net_c, min(full_date) AS full_date
        FROM ord o GROUP BY o.date_key)
  WHERE (full_date - DATE '1970-01-01') % 41 <> 0""",
    "shift": f"""
  SELECT date_key, kitchen_h, driver_h, waste_c,
    {r3('kitchen_h * 1550 + driver_h * 1500', 100)} AS labour_c,
    {r3('gross_c * 35', 1000)} AS pack_c, {r3('gross_c * 112', 10000)} AS pay_c,
    32219 AS fixed_c, {r3('net_c * 7', 100)} AS royal_c FROM hrs""",
    "kday": f"""
  SELECT c.*, o.*, s.kitchen_h, s.driver_h, coalesce(s.labour_c, 0) AS labour_c,
    coalesce(s.waste_c, 0) AS waste_c, coalesce(s.pack_c, 0) AS pack_c,
    coalesce(s.pay_c, 0) AS pay_c, coalesce(s.fixed_c, 0) AS fixed_c,
    coalesce(s.royal_c, 0) AS royal_c,
    o.net_c - o.food_c - coalesce(s.labour_c, 0) - coalesce(s.waste_c, 0)
      - coalesce(s.pack_c, 0) - coalesce(s.pay_c, 0) AS contrib_c,
    o.net_c - o.food_c - coalesce(s.labour_c, 0) - coalesce(s.waste_c, 0)
      - coalesce(s.pack_c, 0) - coalesce(s.pay_c, 0) - coalesce(s.fixed_c, 0)
      - coalesce(s.royal_c, 0) AS profit_c
  FROM cal c JOIN (
    SELECT date_key AS dk, count(*) AS n, count(*) FILTER (WHERE is_delivery) AS trips,
      count(*) FILTER (WHERE NOT is_delivery) AS pickups,
      count(*) FILTER (WHERE is_cancelled) AS cancels,
      CAST(sum(item_qty) AS BIGINT) AS qty, CAST(sum(gross_c) AS BIGINT) AS gross_c,
      CAST(sum(disc_c) AS BIGINT) AS disc_c, CAST(sum(fee_c) AS BIGINT) AS fee_c,
      CAST(sum(comm_c) AS BIGINT) AS comm_c, CAST(sum(net_c) AS BIGINT) AS net_c,
      CAST(sum(food_c) AS BIGINT) AS food_c,
      CAST(sum(actual_min) FILTER (WHERE is_delivery) AS BIGINT) AS mins,
      count(actual_min) FILTER (WHERE is_delivery) AS timed,
      count(*) FILTER (WHERE is_delivery AND is_late) AS late
    FROM ord GROUP BY date_key) o ON o.dk = c.date_key
  LEFT JOIN shift s ON s.date_key = c.date_key""",
    "kpi": f"""
  SELECT date_key, full_date, u, year, month, month_name, month_name_de, iso_week, day_of_week,
    day_name, day_name_de, is_weekend, is_public_holiday, is_school_holiday, temp_mean_c,
    precipitation_mm, is_rainy, n AS orders, trips AS delivery_orders, pickups AS pickup_orders,
    cancels AS cancelled_orders, qty AS items_sold, {eur('gross_c')} AS gross_revenue,
    {eur('disc_c')} AS discount_total, {eur('fee_c')} AS delivery_fee_total,
    {eur('comm_c')} AS commission_total, {eur('net_c')} AS net_revenue,
    {eur('food_c')} AS food_cost, {eur('labour_c')} AS labour_cost, {eur('waste_c')} AS waste_eur,
    {eur('pack_c')} AS packaging_cost, {eur('pay_c')} AS payment_fees,
    {eur('fixed_c')} AS fixed_cost, {eur('royal_c')} AS royalty_cost,
    {eur('kitchen_h')} AS kitchen_hours, {eur('driver_h')} AS driver_hours,
    {eur('contrib_c')} AS contribution_margin,
    {ratio('contrib_c', 'net_c', 100, 1)} AS contribution_margin_pct,
    {eur('profit_c')} AS operating_profit,
    {ratio('profit_c', 'net_c', 100, 1)} AS operating_margin_pct,
    {ratio('fixed_c + labour_c', 'net_c', 100, 1)} AS breakeven_load_pct,
    {ratio('gross_c', 'n * 100')} AS avg_order_value,
    {ratio('food_c', 'gross_c', 100, 1)} AS food_cost_pct,
    {ratio('labour_c', 'gross_c', 100, 1)} AS labour_cost_pct,
    {ratio('trips', 'n', 100, 1)} AS delivery_share_pct,
    {ratio('mins', 'timed', 1, 1)} AS avg_delivery_min,
    {ratio('late', 'trips', 100, 1)} AS late_rate_pct,
    {ratio('n * 100', 'kitchen_h')} AS orders_per_kitchen_hour,
    {ratio('trips * 100', 'driver_h')} AS orders_per_driver_hour,
    gross_c, net_c, food_c, labour_c, waste_c, pack_c, pay_c, fixed_c, royal_c, profit_c, disc_c
  FROM kday""",
    "entry": """
  SELECT business_date, total_orders, gross_c, CASE WHEN total_orders = 0 THEN 0 ELSE buys END AS
      delivery_orders,
    CASE WHEN total_orders = 0 THEN 0 ELSE views - (CASE WHEN u % 7 = 0 THEN 1 ELSE 0 END) END
      AS pickup_orders, errors AS cancelled, (value_c + 50) // 100 AS waste_c,
    CASE WHEN u % 5 = 0 THEN 0 ELSE (30 + u % 9) * 100 END AS staff_h, (12 + u % 4) * 100 AS driver_h,
    u % 7 = 2 AS promo_active, CASE WHEN u % 7 = 2 THEN '2for1' END AS promo_note,
    u % 13 = 0 AS is_closed, CAST(u % 3 AS INTEGER) AS complaints, CAST(NULL AS VARCHAR) AS notes,
    'form' AS entered_by
  FROM (SELECT *, CASE WHEN u % 13 = 0 OR u % 17 = 0 THEN 0 ELSE buys + views END AS total_orders,
          CASE WHEN u % 13 = 0 OR u % 17 = 0 OR u % 11 = 0 THEN 0 ELSE value_c END AS gross_c
        FROM (SELECT business_date, (business_date - DATE '1970-01-01') AS u,
                count(*) FILTER (WHERE event_type = 'purchase') AS buys,
                count(*) FILTER (WHERE event_type = 'view') AS views,
                count(*) FILTER (WHERE event_type = 'error') AS errors,
                CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_c
              FROM (SELECT *, CAST(ts AS DATE) - 8202 AS business_date FROM events)
              GROUP BY business_date))""",
    "actuals": f"""
  SELECT full_date AS business_date, orders AS total_orders, gross_revenue, delivery_orders,
    pickup_orders, waste_eur, kitchen_hours AS staff_hours, driver_hours, avg_order_value,
    operating_profit, FALSE AS is_closed, 'history' AS source FROM kpi
  UNION ALL
  SELECT business_date, total_orders, {eur('gross_c')}, delivery_orders, pickup_orders,
    {eur('waste_c')}, {eur('staff_h')}, {eur('driver_h')}, {ratio('gross_c', 'total_orders * 100')},
    NULL, is_closed, 'form' FROM entry
  WHERE business_date NOT IN (SELECT full_date FROM kpi)""",
}

NEEDS = {
    "weather": ["days"], "filled": ["weather"], "school": ["days"],
    "cal": ["days", "filled", "school"], "ord": ["head", "line", "channel", "zone"],
    "hrs": ["ord"], "shift": ["hrs"], "kday": ["cal", "ord", "shift"], "kpi": ["kday"],
    "actuals": ["kpi", "entry"],
}


def register(name, text, needs=()):
    CTES[name], NEEDS[name] = text, list(needs)


def sql(needs, body):
    """``body`` with the CTEs it needs, dependencies first."""
    order = []

    def visit(n):
        for m in NEEDS.get(n, ()):
            visit(m)
        if n not in order:
            order.append(n)

    for n in needs.split():
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n" + body


def day(expr, name=None):
    return f"CAST({expr} AS VARCHAR) AS {name or expr.split('.')[-1]}"

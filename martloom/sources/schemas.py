"""Declared schemas of the staging and core tables; inputs are never inferred."""

# fixed values: the tables' columns in their order, as DDL
SCHEMAS = {
    "daily_entry": """business_date date not null, total_orders int not null,
        gross_revenue decimal(10,2) not null, delivery_orders int not null,
        pickup_orders int not null, cancelled int not null, waste_eur decimal(10,2) not null,
        staff_hours decimal(6,2) not null, driver_hours decimal(6,2) not null,
        promo_active boolean not null, promo_note string, is_closed boolean not null,
        complaints int not null, notes string, entered_by string, entered_at timestamp""",
    "dim_date": """date_key int not null, full_date date not null, year short not null,
        quarter short not null, month short not null, month_name string not null,
        month_name_de string not null, iso_week short not null, day_of_month short not null,
        day_of_week short not null, day_name string not null, day_name_de string not null,
        is_weekend boolean not null, is_public_holiday boolean not null, holiday_name string,
        is_school_holiday boolean not null, temp_mean_c decimal(5,2), temp_max_c decimal(5,2),
        precipitation_mm decimal(6,2), wind_max_kmh decimal(6,2), is_rainy boolean,
        is_cold boolean""",
    "dim_channel": """channel_key short not null, channel_name string not null,
        is_aggregator boolean not null, commission_rate decimal(5,4) not null""",
    "dim_zone": """zone_key short not null, plz string not null, district_name string not null,
        distance_km decimal(5,2) not null, base_drive_min decimal(5,2) not null,
        delivery_fee decimal(5,2) not null""",
    "dim_item": """item_key int not null, item_name string not null, category string not null,
        size_name string, unit_price decimal(6,2) not null, unit_cost decimal(6,2) not null,
        is_vegetarian boolean not null""",
    "dim_driver": """driver_key short not null, driver_name string not null, hired_on date,
        vehicle string""",
    "dim_customer": """customer_key int not null, customer_code string not null, zone_key short,
        first_order_date date, signup_channel string""",
    "fct_order": """order_key long not null, date_key int not null,
        order_ts timestamp_ntz not null, daypart string not null, customer_key int,
        channel_key short not null, zone_key short, driver_key short,
        is_delivery boolean not null, item_qty short not null,
        gross_amount decimal(8,2) not null, discount_amount decimal(8,2) not null,
        delivery_fee decimal(6,2) not null, commission_amount decimal(8,2) not null,
        net_revenue decimal(8,2) not null, food_cost decimal(8,2) not null,
        promised_min short, actual_min short, is_late boolean, is_cancelled boolean not null,
        promo_code string""",
    "fct_order_item": """order_item_key long not null, order_key long not null,
        date_key int not null, item_key int not null, quantity short not null,
        unit_price decimal(6,2) not null, line_revenue decimal(8,2) not null,
        line_cost decimal(8,2) not null""",
    "fct_shift": """shift_key long not null, date_key int not null,
        kitchen_hours decimal(6,2) not null, driver_hours decimal(6,2) not null,
        labour_cost decimal(8,2) not null, waste_eur decimal(8,2) not null,
        packaging_cost decimal(8,2) not null, payment_fees decimal(8,2) not null,
        fixed_cost decimal(8,2) not null, royalty_cost decimal(8,2) not null""",
    "dim_cost_assumption": """cost_item string not null, cost_type string not null,
        monthly_eur decimal(10,2), pct_of_revenue decimal(6,4), note string""",
}

# parents before children
LOAD_ORDER = ["dim_date", "dim_item", "dim_channel", "dim_zone", "dim_driver",
              "dim_cost_assumption", "dim_customer", "fct_order", "fct_order_item",
              "fct_shift", "daily_entry"]

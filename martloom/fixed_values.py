"""Names, rates and ranges whose exact text or number is part of
the results this library must reproduce. Plain data, natural order."""

from decimal import Decimal

MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July",
             "August", "September", "October", "November", "December"]
MONTHS_DE = ["Januar", "Februar", "Maerz", "April", "Mai", "Juni", "Juli",
             "August", "September", "Oktober", "November", "Dezember"]
DAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
           "Sunday"]
DAYS_DE = ["Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag",
           "Samstag", "Sonntag"]

# name, first hour, hour after the last
DAYPARTS = [("Mittag", 11, 14), ("Nachmittag", 14, 17), ("Abend", 17, 21),
            ("Spaet", 21, 24)]
DAYPART_CODES = {"Mittag": 0, "Nachmittag": 1, "Abend": 2, "Spaet": 3}

# key, name, is_aggregator, commission_rate
CHANNELS = [(1, "Telefon", False, Decimal("0.0000")),
            (2, "Website", False, Decimal("0.0000")),
            (3, "App", False, Decimal("0.0000")),
            (4, "Lieferando", True, Decimal("0.1300")),
            (5, "Abholung", False, Decimal("0.0000"))]

RAINY_ABOVE_MM = 2.0
COLD_BELOW_C = 5.0
HOT_ABOVE_C = 28

KITCHEN_WAGE = Decimal("15.50")
DRIVER_WAGE = Decimal("15.00")
CASHLESS_SHARE = Decimal("0.70")

# item, EUR per month
FIXED_COSTS_MONTHLY = [("Miete", Decimal("3600.00")),
                       ("Energie", Decimal("2100.00")),
                       ("Fahrzeuge", Decimal("1600.00")),
                       ("Versicherungen", Decimal("400.00")),
                       ("Marketing lokal", Decimal("650.00")),
                       ("Verwaltung", Decimal("520.00")),
                       ("Reinigung/Wartung", Decimal("480.00")),
                       ("Sonstiges", Decimal("450.00"))]
# item, share, base it applies to
VARIABLE_COST_RATES = [("Verpackung", Decimal("0.0350"), "gross"),
                       ("Zahlungsgebuehren", Decimal("0.0160"), "cashless"),
                       ("Franchise-Royalty", Decimal("0.0500"), "net"),
                       ("Marketingumlage", Decimal("0.0200"), "net")]

# metric -> inclusive range
PLAUSIBLE = {"aov_eur": (18.0, 30.0), "orders_per_day": (70.0, 200.0),
             "late_pct": (5.0, 25.0), "delivery_min": (25.0, 50.0),
             "food_cost_pct": (25.0, 35.0), "labour_cost_pct": (28.0, 38.0),
             "operating_margin_pct": (5.0, 18.0)}
ENTRY_AOV_RANGE = (12, 45)

# metric -> what an outlier in it means
ANOMALY_CATEGORIES = {"orders": "demand", "discount_rate": "margin leakage",
                      "waste_pct": "waste", "late_rate_pct": "delivery"}

CHURN_BAND_EDGES = [-0.01, 0.33, 0.66, 1.01]
CHURN_BANDS = ["Low", "Medium", "High"]

DELIVERY_FEATURES = ["distance_km", "base_drive_min", "orders_that_day",
                     "daypart_code", "is_rainy", "precipitation_mm",
                     "temp_mean_c", "day_of_week", "item_qty"]
CHURN_FEATURES = ["frequency", "monetary", "avg_order_value", "recency_days",
                  "tenure_days", "orders_per_month", "delivery_share"]
FORECAST_REGRESSORS = ["precipitation_mm", "temp_mean_c", "is_rainy",
                       "is_public_holiday", "is_school_holiday"]

"""Schemas and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# ---------------------------------------------------------------------------

# The 16 spending categories, in enum order.
CATEGORIES = [
    "Food",
    "Transport",
    "Entertainment",
    "Shopping",
    "Bills",
    "Healthcare",
    "Education",
    "Groceries",
    "Rent",
    "Utilities",
    "Subscriptions",
    "Travel",
    "Personal Care",
    "Gifts",
    "Investments",
    "Other",
]

# Category spending thresholds as a share of monthly income, in rule order.
CATEGORY_THRESHOLDS = [
    ("Food", 0.30),
    ("Shopping", 0.15),
    ("Entertainment", 0.10),
    ("Transport", 0.15),
    ("Travel", 0.10),
    ("Subscriptions", 0.05),
    ("Personal Care", 0.05),
    ("Gifts", 0.05),
]
# Threshold used by the category explanation for categories not listed above.
DEFAULT_CATEGORY_THRESHOLD = 0.15

SAVINGS_INVEST_THRESHOLD = 0.20
MIN_EMERGENCY_FUND_MONTHS = 3
OVERSPEND_INCOME_SHARE = 0.9

# Risk level ladder, tried from the highest threshold down (>=).
RISK_THRESHOLDS = [
    ("critical", 0.85),
    ("high", 0.7),
    ("medium", 0.5),
    ("low", 0.3),
]

# Priority order for sorting recommendations; anything else sorts last (99).
PRIORITY_ORDER = [("high", 0), ("medium", 1), ("low", 2)]

# Risk-model feature descriptions.
FEATURE_DESCRIPTIONS = [
    ("total_spending", "Total amount spent in the period"),
    ("transaction_count", "Number of transactions made"),
    ("avg_transaction", "Average transaction amount"),
    ("max_transaction", "Largest single transaction"),
    ("spending_to_income", "Ratio of spending to monthly income"),
    ("prev_month_spending", "Previous month's total spending"),
    ("spending_change", "Month-over-month spending change"),
    ("rolling_3m_avg", "3-month rolling average of spending"),
    ("rolling_3m_std", "Spending volatility over 3 months"),
    ("unique_categories", "Number of spending categories used"),
    ("unique_merchants", "Number of unique merchants"),
]

# Input bounds of one transaction and of one upload batch.
MERCHANT_MAX_CHARS = 255
DESCRIPTION_MAX_CHARS = 500
BATCH_MIN_ROWS = 1
BATCH_MAX_ROWS = 1000
DEFAULT_CURRENCY = "INR"

# Classifier feature vector, in order (amount_squared is computed, not used).
CLASSIFIER_FEATURES = [
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "is_month_start",
    "is_month_end",
    "quarter",
    "week_of_year",
    "log_amount",
    "amount",
    "merchant_encoded",
]

# Daily forecast features: rolling windows and lags (rows, not calendar days).
FORECAST_WINDOWS = [3, 7, 14, 30]
FORECAST_LAGS = [1, 2, 3, 7]
FORECAST_RIDGE_ALPHA = 1.0
FORECAST_MIN_DAYS = 10
FORECAST_MAX_DAYS = 60
FORECAST_DEFAULT_DAYS = 30
RIDGE_BAND = 0.3
# Seasonal model: the reference's prior scales and its extra monthly term.
CHANGEPOINT_PRIOR_SCALE = 0.05
SEASONALITY_PRIOR_SCALE = 10.0
MONTHLY_PERIOD_DAYS = 30.5
MONTHLY_FOURIER_ORDER = 5

LIST_DEFAULT_LIMIT = 100
LIST_MAX_LIMIT = 500
TOP_MERCHANTS = 10
MAX_ANOMALIES = 5

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("full_name", T.StringType(), True),
        T.StructField("monthly_income", T.DoubleType(), False),
        T.StructField("currency", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("merchant", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("predicted_category", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)

# Raw upload: every field a string until validated.
RAW_UPLOAD = T.StructType(
    [
        T.StructField("batch_id", T.StringType(), True),
        T.StructField("user_id", T.StringType(), True),
        T.StructField("date", T.StringType(), True),
        T.StructField("amount", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("merchant", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

# CSV file with header date, amount, category[, merchant, description].
CSV_TRANSACTIONS = T.StructType(
    [
        T.StructField("date", T.StringType(), True),
        T.StructField("amount", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("merchant", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

TRANSACTION_OUT_COLUMNS = [
    "id",
    "user_id",
    "date",
    "amount",
    "category",
    "merchant",
    "description",
    "predicted_category",
    "created_at",
]


def ratio_column(category: str) -> str:
    """Pivot column name of a category share: ``ratio_`` + lower + ``_`` for space."""
    return "ratio_" + category.lower().replace(" ", "_")


RATIO_COLUMNS = [ratio_column(c) for c in CATEGORIES]

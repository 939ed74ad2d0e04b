"""Message, summary and explanation templates.

The wording follows the reference's texts, in the order they appear there.
Placeholders are Spark ``format_string`` specifiers: ``%s`` takes an already
formatted number (``format_number`` for whole amounts, a whole percent), ``%d``
takes an integer. The texts are presentation only; registered queries compare
the structured fields, not these strings.
"""

# ---------------------------------------------------------------------------
# Recommendation messages (J1-J6), in rule order.
# ---------------------------------------------------------------------------
CATEGORY_OVERSPEND = "Reduce %s spending by ₹%s (%s of income vs %s recommended threshold)"
RISK_HIGH = "⚠️ High risk of overspending this month! Probability: %s. Projected spending: ₹%s vs income ₹%s"
RISK_MEDIUM = "Moderate overspending risk detected (%s probability). Consider reducing discretionary spending."
RISK_LOW = "Slight overspending risk (%s probability). You're mostly on track — keep monitoring."
FORECAST_HIGH = (
    "Forecast shows spending of ₹%s over next %d days. This exceeds your income — immediate action recommended!"
)
FORECAST_MEDIUM = "Forecast predicts ₹%s spending in %d days (%s of income). Monitor closely."
INVEST = (
    "💰 You can safely invest ₹%s/month! Your savings rate is %s (₹%s/month surplus). "
    "Consider SIPs in index funds or fixed deposits."
)
EMERGENCY_FUND = "Maintain an emergency fund of at least ₹%s (%d months expenses)."
ANOMALY = "Unusual %s transaction of ₹%s detected on %s (category average: ₹%s)"
RISING_TREND = (
    "📈 Spending has increased %s%% over the last 3 months. "
    "Review and adjust your budget to prevent overspending."
)

# ---------------------------------------------------------------------------
# Recommendation summary.
# ---------------------------------------------------------------------------
SUMMARY_HEALTHY = "Your finances look healthy! No immediate actions needed."
SUMMARY_CRITICAL = "⚠️ %d critical issues found. Immediate attention required on spending and budget management."
SUMMARY_REVIEW = "%d recommendations generated, including %d high-priority alert(s). Review the critical items first."
SUMMARY_SUGGESTIONS = "%d suggestions to optimize your finances. No critical issues — focus on long-term improvements."

# ---------------------------------------------------------------------------
# Explanations (K2-K8), in the reference's order.
# ---------------------------------------------------------------------------
# K2 risk
RISK_VELOCITY_FACTOR = "Spending velocity is accelerating — recent week is above monthly average"
RISK_SHARE_FACTOR = "Current spending is %s of monthly income"
RISK_MODEL_FACTOR = "Model predicts %s probability of exceeding budget"
RISK_REASONING = (
    "The overspend risk score of %s is driven by your current spending trajectory (₹%s so far this month) "
    "relative to your income of ₹%s. %scontributing to the elevated risk assessment."
)
RISK_VELOCITY_CLAUSE = "Spending velocity has increased recently, "
# K3 category
CATEGORY_REASONING = (
    "Your %s spending is %s of income (recommended threshold: %s). Average monthly spend: ₹%s. %s "
    "Reducing by ₹%s/month would bring it within recommended limits."
)
CATEGORY_TREND_CLAUSE = "The trend is increasing, amplifying the concern."
CATEGORY_SHARE_FEATURE = "%s Spending %%"
CATEGORY_SHARE_DESCRIPTION = "Percentage of income spent on %s"
CATEGORY_TREND_FEATURE = "%s Trend"
CATEGORY_TREND_DESCRIPTION = "Spending trend for %s is %s"
CATEGORY_SHARE_FACTOR = "High %s spending at %s of income"
CATEGORY_TREND_FACTOR = "%s spending trend"
CATEGORY_AVERAGE_FACTOR = "Monthly average: ₹%s"
# K4 forecast
FORECAST_REASONING = (
    "Based on %s forecasting model analysis of your historical spending, the projected spending of ₹%s over "
    "%d days suggests %s. This forecast accounts for weekly patterns, seasonal trends, and your recent behavior."
)
FORECAST_PRESSURE = "budget pressure"
FORECAST_MANAGEABLE = "manageable spending"
FORECAST_IMPACTS = [
    ("Historical Spending Pattern", 0.4, "positive", "Past spending behavior is the strongest predictor"),
    ("Weekly Seasonality", 0.25, "positive", "Day-of-week spending patterns affect projections"),
]
FORECAST_MODEL_FACTOR = "Forecast model: %s"
FORECAST_TOTAL_FACTOR = "Projected %d-day total: ₹%s"
FORECAST_RMSE_FACTOR = "RMSE: %s"
# K5 savings
SAVINGS_REASONING = (
    "Your average monthly spending of ₹%s leaves ₹%s in savings (%s savings rate). Financial advisors recommend "
    "investing surplus beyond 20%% of income for long-term wealth building. SIPs in diversified equity funds or "
    "debt funds are good starting options."
)
SAVINGS_RATE_FACTOR = "Savings rate: %s"
SAVINGS_SURPLUS_FACTOR = "Monthly surplus: ₹%s"
SAVINGS_FLOW_FACTOR = "Consistent positive cash flow observed"
# K6 anomaly
ANOMALY_REASONING = (
    "This transaction was flagged because it significantly deviates from your typical spending in the %s "
    "category. Transactions exceeding 3 standard deviations from the mean are considered unusual and may "
    "warrant review."
)
ANOMALY_FACTORS = [
    "Amount significantly exceeds category average",
    "Statistical outlier (>3 standard deviations)",
    "May indicate an error or one-time expense",
]
# K7 trend
TREND_REASONING = (
    "Your spending has increased by %s%% over the last 3 months (₹%s → ₹%s). If this trend continues, you "
    "risk exceeding your budget. Identifying and reducing discretionary expenses can help stabilize spending."
)
TREND_CHANGE_FACTOR = "3-month spending increase: %s%%"
TREND_FIRST_FACTOR = "Month 1: ₹%s"
TREND_LAST_FACTOR = "Month 3: ₹%s"
# K8 default
DEFAULT_REASONING = "This recommendation is based on your overall spending patterns and financial health indicators."
DEFAULT_FACTORS = ["Overall spending analysis", "Income-to-expense ratio"]

"""Fixed values.

These strings and thresholds must equal those of the analyses being
reproduced, so they are stated here once, plainly and in natural order.
"""

# --- fixed values: event names in the log --------------------------------
OFFER_RECEIVED = "offer received"
OFFER_VIEWED = "offer viewed"
TRANSACTION = "transaction"
OFFER_COMPLETED = "offer completed"

# --- fixed values: offer types and channels ------------------------------
INFORMATIONAL = "informational"
CHANNELS = ["email", "mobile", "social", "web"]

# --- fixed values: age bands (upper bounds inclusive, integer ages) -------
AGE_UNDER_30 = "Under 30"
AGE_30_45 = "30-45"
AGE_46_60 = "46-60"
AGE_61_75 = "61-75"
AGE_76_PLUS = "76+"

# --- fixed values: income bands (lower bound inclusive) -------------------
INCOME_LOW = "Low Income"                   # income < 51000
INCOME_LOWER_MIDDLE = "Lower-Middle Income"  # 51000 <= income < 63000
INCOME_UPPER_MIDDLE = "Upper-Middle Income"  # 63000 <= income < 76000
INCOME_HIGH = "High Income"                 # income >= 76000
INCOME_EDGES = [51000, 63000, 76000]

# --- fixed values: time-to-view bands (hours, upper bound inclusive) ------
VIEW_QUICK = "Quick Viewer (<=1 day)"        # <= 24
VIEW_MODERATE = "Moderate Viewer (1–3 days)"  # <= 72 (the dash is an en dash)
VIEW_LATE = "Late Viewer (>3 days)"
VIEW_EDGES = [24, 72]

# --- fixed values: box-plot outlier classes --------------------------------
LOW_OUTLIER = "Low Outlier"
HIGH_OUTLIER = "High Outlier"
NORMAL = "Normal"
IQR_FACTOR = 1.5

# --- fixed values: profile cleaning ----------------------------------------
AGE_PLACEHOLDER = 118          # age recorded for unknown customers
GENDER_DRAW = [("F", 0.41), ("M", 0.98)]  # cumulative thresholds, else "O"
GENDER_OTHER = "O"
SALARY_BIN = 10000
CURRENCY_SYMBOL = "₹"          # Indian-rupee text with lakh digit grouping
HOURS_PER_DAY = 24

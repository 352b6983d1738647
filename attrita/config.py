"""Parameters of the churn analytics.

Everything below marked FIXED VALUES must equal the dashboard this package
re-implements, or results differ (bin edges, rule weights, thresholds, labels,
strategy templates). They are kept together, in their natural order, as plain
data so the Spark jobs read them as parameters instead of hard-coding them.
"""

from __future__ import annotations

import datetime as _dt

# --------------------------------------------------------------------------
# FIXED VALUES: feature engineering
# --------------------------------------------------------------------------

# Right-closed bins (a, b] -> code.  Age: (0,30] (30,40] (40,50] (50,60] (60,100].
AGE_EDGES = [0, 30, 40, 50, 60, 100]
AGE_LABELS = ["18-30", "30-40", "40-50", "50-60", "60+"]

# Credit score: (0,600] (600,650] (650,700] (700,850].
CREDIT_EDGES = [0, 600, 650, 700, 850]
CREDIT_LABELS = ["Poor", "Fair", "Good", "Excellent"]

# Tenure: (-1,2] (2,5] (5,7] (7,10].
TENURE_EDGES = [-1, 2, 5, 7, 10]
TENURE_LABELS = ["New", "Established", "Loyal", "Very Loyal"]

# Complain risk score terms: age > 45 -> 2, products >= 3 -> 1.5,
# inactive -> 2, zero balance -> 1  (range 0 .. 6.5).
COMPLAIN_AGE_OVER = 45
COMPLAIN_PRODUCTS_AT_LEAST = 3
COMPLAIN_WEIGHT_AGE = 2.0
COMPLAIN_WEIGHT_PRODUCTS = 1.5
COMPLAIN_WEIGHT_INACTIVE = 2.0
COMPLAIN_WEIGHT_ZERO_BALANCE = 1.0

ACTIVITY_LABELS = ["Inactive", "Active"]          # IsActiveMember 0, 1
CLASS_LABELS = ["Not Churned", "Churned"]         # Exited 0, 1

# Feature lists used by the profiling pages.
NUMERIC_COLUMNS = ["credit_score", "age", "tenure", "balance", "num_products", "estimated_salary"]
CORRELATION_COLUMNS = NUMERIC_COLUMNS + ["exited"]
ORIGINAL_FEATURES = ["credit_score", "age", "tenure", "balance", "num_products", "estimated_salary"]
ENGINEERED_FEATURES = ["balance_to_salary_ratio", "tenure_by_age", "products_per_year",
                       "complain_risk_score", "is_high_value", "has_zero_balance"]
# FIXED VALUES: escalation triggers and their actions
ESCALATION_ACTIONS = {
    "No activity": "Personal call",
    "Closed account attempt": "Urgent intervention",
    "Negative feedback": "Immediate resolution",
    "Balance drop": "Relationship check",
}
ESCALATION_DROP_TO = 0.5
# Parameters: days without activity (30 in the plan; the events table covers 30 days in all), and the event types and
# values that stand for a sign in the events table, which has no feedback or closing events.
ESCALATION_INACTIVE_DAYS = 1.0
ESCALATION_SIGNS = [("Closed account attempt", "error", 250.0, float("inf")), ("Negative feedback", "error", 150.0, 250.0)]
# The late-file queries: days a file covers, one event in so many is late, by so many files.
LATE_SLOT_DAYS, LATE_EVERY, LATE_SLOTS = 3, 40, 4
# The CSV query spoils a line in so many, in five ways.
SPOILT_EVERY = 29
WIDE_CORRELATION_COLUMNS = NUMERIC_COLUMNS + ["has_cr_card", "is_active_member"] + ENGINEERED_FEATURES + [
    "age_group", "credit_score_category", "tenure_category", "active_high_balance", "exited"]

HISTOGRAM_BINS = 30          # feature histograms
RISK_HISTOGRAM_BINS = 15     # risk score histogram
RISK_SCORE_LEVELS = 7        # equal-width bins of the complain risk score

# --------------------------------------------------------------------------
# FIXED VALUES: rule scoring of one customer
# (factor, weight in hundredths, factor text). Weights are summed as integers
# and divided by 100 once, so every engine gets the same double.
# --------------------------------------------------------------------------

RULE_AGE_OVER = 45
RULE_WEIGHT_AGE = 25
RULE_WEIGHT_INACTIVE = 30
RULE_WEIGHT_ONE_PRODUCT = 15
RULE_WEIGHT_MANY_PRODUCTS = 20          # num_products >= 3
RULE_HIGH_RISK_GEOGRAPHY = "Germany"    # a parameter: the test tables use EUROPE
RULE_WEIGHT_GEOGRAPHY = 15
RULE_WEIGHT_ZERO_BALANCE = 15
RULE_VERY_HIGH_BALANCE = 200000
RULE_WEIGHT_VERY_HIGH_BALANCE = 10
RULE_TENURE_UNDER = 2
RULE_WEIGHT_TENURE = 10
RULE_WEIGHT_FEMALE = 5                  # adds weight, no factor text
RULE_WEIGHT_NO_CARD = 3
RULE_CREDIT_UNDER = 600
RULE_WEIGHT_CREDIT = 5

RULE_PROBABILITY_CAP = 95               # hundredths: min(score, 0.95)
RULE_HIGH_ABOVE = 0.5                   # risk level thresholds (strict)
RULE_MEDIUM_ABOVE = 0.3
CONFIDENCE_BASE = 70
CONFIDENCE_PER_FACTOR = 5
CONFIDENCE_CAP = 95
CUSTOMER_LTV = 75000

# Factor texts; "{}" is the customer's own value.
TEXT_AGE = "⚠️ Age > 45 ({} years) - older customers show higher churn risk"
TEXT_INACTIVE = "🔴 Inactive member - critical disengagement signal"
TEXT_ONE_PRODUCT = "⚠️ Only {} product - low engagement risk"
TEXT_MANY_PRODUCTS = "🔴 {} products - complexity/dissatisfaction risk"
TEXT_GEOGRAPHY = "📍 Germany - historically higher churn region (32% vs 17%)"
TEXT_ZERO_BALANCE = "💰 Zero balance - disengagement signal"
TEXT_VERY_HIGH_BALANCE = "💰 Very high balance - may seek better returns elsewhere"
TEXT_TENURE = "⏱️ Low tenure - new customer attrition risk"
TEXT_NO_CARD = "💳 No credit card - lower product engagement"
TEXT_CREDIT = "📊 Low credit score ({}) - financial stress indicator"

# Targeted actions for HIGH risk, keyed by the factors present.
ACTION_AGE = "Age-specific: Senior customer support line, personalized service, relationship banking"
ACTION_REACTIVATE = "Reactivation: Incentives to use mobile app, gamification, engagement rewards"
ACTION_SIMPLIFY = "Simplification: Help consolidate products, reduce complexity, streamline services"
ACTION_CROSS_SELL = "Cross-sell: Introduce beneficial 2nd product with strong value proposition"
ACTION_REGIONAL = "Regional: Germany-specific retention team, local market expert consultation"
ACTION_FINANCIAL = "Financial: Better rates, investment options, wealth management consultation"
# Actions for MEDIUM risk.
ACTION_MEDIUM_ONE_PRODUCT = "Cross-sell Priority: Strong opportunity for 2nd product - offer $100 cashback incentive"
ACTION_MEDIUM_INACTIVE = "Reactivation Focus: Digital engagement campaign, app benefits, online banking features"
ACTION_MEDIUM_NEW = "New Customer Care: Extra attention during onboarding period, check-in calls, welcome bonus"
MEDIUM_TENURE_UNDER = 3

# Plan per risk level: (level, plan, timeframe, steps, expected outcome,
# investment, cost for the ROI).  ROI = (LTV - cost) / cost.
RISK_PLANS = [
    ("HIGH", "URGENT ACTION REQUIRED - High Risk Customer", "Within 24 hours",
     ["Priority 1: Personal Contact - Call from senior relationship manager; "
      "Schedule face-to-face meeting if possible; Address concerns and gather detailed feedback; "
      "Executive escalation path if needed",
      "Priority 2: Retention Package - Waive all fees for 12 months (value: $300); "
      "Offer 0.5% interest rate boost on savings; Complimentary premium services for 6 months; "
      "Special deals on loans/mortgages if applicable",
      "Priority 3: Issue Resolution - Fast-track any pending issues/complaints; "
      "Assign dedicated customer success manager; Weekly check-ins for next 3 months; "
      "VIP customer status and priority support"],
     "Retention Probability: 70-80%", "$500-800", 800),
    ("MEDIUM", "PROACTIVE ENGAGEMENT RECOMMENDED - Medium Risk", "Within 1 week",
     ["Step 1: Personalized Communication - Send customized email highlighting unused benefits; "
      "Showcase relevant products based on profile; Include exclusive offer (e.g., cashback promotion); "
      "Provide direct contact to relationship manager",
      "Step 2: Engagement Campaign - Invite to exclusive banking webinar; "
      "Offer free financial planning consultation; Provide mobile app tutorial and perks; "
      "Exclusive access to new features/products",
      "Step 3: Feedback Loop - Send satisfaction survey with incentive; Monitor account activity weekly; "
      "Alert if behavior signals increase risk; Monthly touchpoint emails"],
     "Retention Improvement: 15-20%", "$100-200", 200),
    ("LOW", "MAINTAIN & GROW RELATIONSHIP - Low Risk", "Quarterly",
     ["Opportunity 1: Upselling - Recommend additional products (investment, insurance); "
      "Offer premium credit card upgrade; Propose wealth management services; Higher tier account benefits",
      "Opportunity 2: Loyalty Program - Enroll in VIP rewards program; Provide exclusive partner discounts; "
      "Offer referral bonuses ($100 per referral); Recognition for long-term loyalty",
      "Opportunity 3: Regular Touchpoints - Quarterly check-in emails; Birthday/anniversary recognition; "
      "Proactive service updates; Financial planning reviews"],
     "Additional Revenue: $5,000-10,000/year | Referrals: 1-2 new customers | LTV Increase: 15-20% | "
     "Retention: >95%", "", None),
]

# --------------------------------------------------------------------------
# FIXED VALUES: segmentation
# --------------------------------------------------------------------------

# Columns and centres (in standard deviations) of the query that judges given clusters.
CENTRE_COLUMNS = ["credit_score", "age", "tenure", "balance", "num_products", "estimated_salary", "is_active_member"]
GIVEN_CENTRES = [[0.0, -0.8, 0.2, -0.5, -0.3, -0.2, 0.9], [0.1, 0.9, 0.2, -0.4, 0.4, 0.1, 0.9],
                 [-0.2, 0.1, -0.1, 1.3, 0.0, 0.2, -0.4], [0.0, 0.0, -0.4, -0.3, 0.1, -0.1, -1.1]]
# Folds whose out-of-fold margins a margin model is calibrated on.
CALIBRATION_FOLDS = 3
N_CLUSTERS = 4
KMEANS_RESTARTS = 10
SEED = 42
RISK_LABELS = ["HIGH RISK", "MEDIUM RISK", "LOW-MEDIUM RISK", "LOW RISK"]

# Cluster naming thresholds: active % < 10 / > 90, balance 80k / 50k, tenure 3.
NAME_INACTIVE_BELOW = 10
NAME_ACTIVE_ABOVE = 90
NAME_HIGH_BALANCE_ABOVE = 80000
NAME_LOW_BALANCE_BELOW = 50000
NAME_SHORT_TENURE_BELOW = 3

# Strategy template per risk rank:
# (rank, title, priority, budget %, expected retention improvement %, roi, save rate)
STRATEGIES = [
    (0, "Urgent Reactivation — Highest Priority", "URGENT", 40, 25, "Very High", 0.31),
    (1, "Active Re-engagement — High Priority", "High", 30, 15, "High", 0.15),
    (2, "Premium Services — Medium Priority", "Medium", 20, 10, "Medium-High", 0.10),
    (3, "Loyalty & Upselling — Maintain & Grow", "Low", 10, 5, "High (Long-term)", 0.05),
]
# Description and actions per risk rank.
STRATEGY_DESCRIPTIONS = [
    "Highest churn cluster. Likely disengaged or inactive customers who are at serious risk of leaving.",
    "Second-highest churn cluster. Moderate engagement; targeted outreach can significantly improve retention.",
    "Stable and mostly engaged customers. Worth investing in to deepen relationship and increase product holdings.",
    "Lowest churn cluster — loyal, satisfied customers. Focus on retention and growing wallet share.",
]
STRATEGY_ACTIONS = [
    ["Immediate: Personal call from a senior relationship manager",
     "Fast Resolution: Address all pending issues and complaints immediately",
     "Retention Package: Fee waivers for 6–12 months",
     "Special Rates: Preferential interest rates on savings and loans",
     "Dedicated Support: Priority customer support line",
     "Relationship Building: Quarterly check-ins, VIP status, exclusive events"],
    ["Personalised email / SMS campaigns based on usage patterns",
     "Product cross-sell and upsell opportunities",
     "Loyalty points and cashback programmes",
     "Financial health check-ups and advisory sessions",
     "Bundled product discounts and incentives"],
    ["Private banking / wealth management invitations",
     "Premium credit cards with exclusive perks",
     "Tailored investment portfolio recommendations",
     "Travel and lifestyle benefits",
     "Digital banking feature enhancements"],
    ["Offer premium investment and savings products",
     "Cashback programmes and exclusive partner discounts",
     "Credit limit increases and card upgrades",
     "Referral bonuses for bringing new customers",
     "Fee reductions for long-term loyalty"],
]
# The save rates in whole percent, for exact integer arithmetic.
STRATEGY_SAVE_PCT = [int(round(rate * 100)) for *_, rate in STRATEGIES]
CAMPAIGN_INVESTMENT_M = 0.28     # top-cluster campaign, $M
TOTAL_INVESTMENT_M = 0.7         # all clusters, $M

# --------------------------------------------------------------------------
# FIXED VALUES: explanation bands (contribution by band)
# --------------------------------------------------------------------------

# (upper bound, label): bounds are exclusive, but for the last one: the open
# band after it starts above it.  Age bands: < 30, 30-45, 45-60, > 60.
EXPLAIN_AGE_BANDS = [(30, "<30"), (45, "30-45"), (60, "45-60"), (None, ">60")]
# Balance bands: 0, 1-50k, 50k-150k, > 200k; 150k-200k, for which no figure is
# given, has a label of its own.
EXPLAIN_BALANCE_BANDS = [(50000, "1-50k"), (150000, "50k-150k"), (200000, "150k-200k"), (None, ">200k")]

# --------------------------------------------------------------------------
# FIXED VALUES: model
# --------------------------------------------------------------------------

GBT_PARAMS = dict(maxIter=100, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8", seed=SEED)
TEST_FRACTION = 0.2
# Grid search (M10): parameters tried, sizes of the ensembles read off one fit, folds.
GBT_GRID = {"maxDepth": (3, 5), "stepSize": (0.05, 0.1)}
GBT_GRID_SIZES = (50, 100)
RF_GRID = {"maxDepth": (5, 8), "minInstancesPerNode": (1, 5)}
RF_GRID_SIZES = (50, 100)
GRID_FOLDS = 5

# --------------------------------------------------------------------------
# Parameters of the profile built from the star-schema test tables
# (see FIXTURES.md): features before the cutoff, label from the cutoff on.
# --------------------------------------------------------------------------

PROFILE_CUTOFF = _dt.datetime(2000, 8, 1)
PROFILE_ACTIVE_SINCE = _dt.datetime(2000, 2, 1)
PROFILE_TENURE_YEAR = 2000
PROFILE_BALANCE_SCALE = 25.0
PROFILE_URGENT_PRIORITY = "1-URGENT"
TEST_HIGH_RISK_REGION = "EUROPE"

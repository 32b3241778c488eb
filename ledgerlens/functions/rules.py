"""Business rule tables, kept as data and turned into Spark expressions.

Everything under a "Fixed values" comment must equal the reference's
constants for results to match; it is stated here plainly, in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment rules on (recency_score, frequency_score, monetary_score),
# in the reference's mask order. Each bound is (operator, threshold).
SEGMENT_RULES = [
    ("High Value", (">=", 4), (">=", 4), (">=", 4)),
    ("Loyal", (">=", 3), (">=", 4), (">=", 3)),
    ("New", (">=", 4), ("<=", 2), (">=", 2)),
    ("At Risk", ("<=", 2), (">=", 3), (">=", 2)),
    ("Low Engagement", ("<=", 2), ("<=", 2), ("<=", 2)),
]
DEFAULT_SEGMENT = "Other"
SEGMENT_NAMES = [r[0] for r in SEGMENT_RULES] + [DEFAULT_SEGMENT]

# Segments counted as "healthy" on the KPI row.
HEALTHY_SEGMENTS = ["High Value", "Loyal"]

# Growth assumptions used by the insight opportunities.
HIGH_VALUE_EXPANSION_RATE = 0.15
LOYAL_AT_RISK_RATE = 0.10
NEW_CONVERSION_RATE = 0.3
AT_RISK_RECOVERY_RATE = 0.3

# Growth signals (segment, uplift factor, action), in order.
GROWTH_SIGNALS = [
    ("High Value", 0.15, "Introduce premium upsell tier with exclusive access"),
    ("Loyal", 0.10, "Cross-sell adjacent product categories"),
    ("New", 0.30, "Deploy automated first-repeat-purchase email sequence"),
    ("At Risk", 0.30, "Win-back campaign with time-limited special offer"),
]

# Risk urgency tiers on the at-risk share of customers (strict >).
RISK_URGENCY_HIGH_PCT = 15
RISK_URGENCY_MEDIUM_PCT = 8

# Segment playbook (segment, headline, description, action, urgency).
SEGMENT_PLAYBOOK = [
    ("High Value",
     "Top revenue drivers — protect and grow",
     "High Value customers deliver the highest revenue and purchase most frequently. "
     "They represent the core of business profitability and must be retained at all costs.",
     "Launch a VIP loyalty programme with exclusive benefits and priority support.",
     "Maintain"),
    ("Loyal",
     "Consistent buyers — deepen the relationship",
     "Loyal customers return regularly and provide predictable revenue. "
     "They are strong candidates for upselling and cross-selling initiatives.",
     "Introduce tiered rewards and personalised product recommendations.",
     "Grow"),
    ("New",
     "Recent acquistions — convert to repeat buyers",
     "New customers have made an initial purchase but have not yet established a "
     "purchasing habit. Early engagement is critical to long-term retention.",
     "Deploy a welcome series with a second-purchase incentive within 14 days.",
     "Activate"),
    ("At Risk",
     "Churning customers — win back before they leave",
     "At Risk customers were once active but have gone quiet. "
     "They represent a significant revenue recovery opportunity with targeted campaigns.",
     "Launch a \"We Miss You\" win-back campaign with a limited-time offer.",
     "Urgent"),
    ("Low Engagement",
     "Dormant segment — cost-effective reactivation",
     "Low Engagement customers show minimal activity and spend. "
     "A small percentage can be reactivated with the right message at low cost.",
     "Run a low-cost A/B test to identify reactivation triggers.",
     "Monitor"),
]
# Playbook defaults for a segment not in the table ({seg} = segment name).
PLAYBOOK_DEFAULT = ("{seg} segment", "{seg} customers require tailored engagement.",
                    "Review segment behaviour and define targeted strategy.", "Review")

# Insight opportunity texts (key, description, action).
OPPORTUNITY_TEXT = [
    ("high_value_expansion", "Expand High Value segment through targeted upselling",
     "Implement premium tier loyalty program"),
    ("loyal_retention", "Retain Loyal segment with enhanced engagement",
     "Increase engagement frequency through personalized communications"),
    ("new_customer_conversion", "Convert New customers to repeat buyers",
     "Deploy welcome series with exclusive first-purchase incentives"),
    ("at_risk_recovery", "Win back At Risk customers before full churn",
     "Launch \"We Miss You\" campaign with special comeback offers"),
]

# The executive sentences (revenue focus, volume focus, risk alert, opportunities).
EXECUTIVE_SENTENCES = (
    "%s is the top revenue driver, contributing %s%% of total revenue (%d customers)",
    "%s is the largest segment by count (%d customers, %s%% of base)",
    "%d customers are At Risk (%s%% of base), representing $%s in potential revenue loss",
    "%d growth opportunities identified",
)

# The executive paragraph, part by part, and its bullets.
EXECUTIVE_OPENING = "Analysis of %s customers generating $%s in total revenue reveals five distinct behavioural segments with clear strategic implications."
EXECUTIVE_HIGH_VALUE = (
    "The High Value segment (%s customers) is the primary revenue engine, contributing %.1f%% of total revenue despite representing only "
    "%.1f%% of the customer base — a clear sign of revenue concentration risk that warrants a dedicated retention programme.")
EXECUTIVE_AT_RISK = (
    "A significant at-risk cohort of %s customers ($%s in historical revenue) is showing signs of churn. With an estimated 30%% recovery "
    "rate, a targeted win-back campaign could recover approximately $%s in revenue.")
EXECUTIVE_NEW = (
    "The New segment (%s customers) presents the strongest organic growth opportunity. Converting 30–40%% to repeat buyers "
    "through a structured onboarding sequence could add meaningful incremental revenue over the next 90 days.")
EXECUTIVE_PRIORITIES = (
    "Immediate priorities are: (1) protect High Value and Loyal customers through premium engagement, "
    "(2) recover At Risk customers before full churn, and (3) activate New customers with a targeted first-repeat-purchase incentive.")
EXECUTIVE_BULLETS = (
    "%s segment drives %.1f%% of total revenue",
    "%s is the largest segment with %s customers",
    "%s At Risk customers represent $%s in recoverable revenue",
    "%s New customers are ready for conversion campaigns",
    "5 strategic actions identified across all segments",
)

# Risk summary recommended actions (with / without at-risk customers).
RISK_ACTION = ("Launch a \"We Miss You\" campaign with a 10–15% discount code, "
               "targeting customers inactive for 60+ days.")
RISK_ACTION_NONE = "No at-risk customers detected — maintain monitoring cadence."

# Cluster label suffixes by centroid sign pattern.
CLUSTER_LABELS = {
    "active_high": "Active_High_Value",
    "inactive_high": "Inactive_High_Value",
    "frequent_low": "Frequent_Low_Value",
    "infrequent_high": "Infrequent_High_Value",
    "low": "Low_Activity",
}

_OPS = {">=": lambda c, t: c >= t, "<=": lambda c, t: c <= t,
        ">": lambda c, t: c > t, "<": lambda c, t: c < t, "==": lambda c, t: c == t}


def rule_predicate(rule, r: Column, f: Column, m: Column) -> Column:
    _, (ro, rt), (fo, ft), (mo, mt) = rule
    return _OPS[ro](r, rt) & _OPS[fo](f, ft) & _OPS[mo](m, mt)


def segment_expr(r: str | Column = "recency_score", f: str | Column = "frequency_score",
                 m: str | Column = "monetary_score", mode: str = "last_match",
                 rules=SEGMENT_RULES, default: str = DEFAULT_SEGMENT) -> Column:
    """Rule table as one CASE expression.

    ``last_match`` reproduces the reference's sequential mask overwrites
    (a later rule wins), so the chain is built in reverse order;
    ``first_match`` applies the rules in documented priority.
    """
    if mode not in ("last_match", "first_match"):
        raise ValueError("mode must be 'last_match' or 'first_match'")
    r, f, m = (F.col(x) if isinstance(x, str) else x for x in (r, f, m))
    ordered = list(reversed(rules)) if mode == "last_match" else list(rules)
    expr = None
    for rule in ordered:
        pred = rule_predicate(rule, r, f, m)
        expr = F.when(pred, F.lit(rule[0])) if expr is None else expr.when(pred, F.lit(rule[0]))
    return expr.otherwise(F.lit(default))

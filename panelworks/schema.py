"""Column roles and fixed values of the loan panel."""

from __future__ import annotations

# The state ladder in its order, and what follows from it.
STATES = ["Current", "30DPD", "60DPD", "90DPD", "Default", "Prepaid"]
ABSORBING = ["Default", "Prepaid"]
DELINQUENT = ["30DPD", "60DPD", "90DPD"]
SEVERITY = {"Current": 0, "30DPD": 1, "60DPD": 2, "90DPD": 3, "Default": 4, "Prepaid": 0}
REQUIRED = ["loan_id", "month_index", "reporting_month", "current_status"]

# Days past due that a state allows.
DPD_BANDS = {"Current": (0, 0), "30DPD": (30, 59), "60DPD": (60, 89), "90DPD": (90, 10000), "Default": (90, 10000), "Prepaid": (0, 0)}

# Midpoints of banded attributes.
CREDIT_MIDPOINTS = {"<620": 600, "620-659": 640, "660-699": 680, "700-739": 720, "740-779": 760, "780+": 800}
LTV_MIDPOINTS = {"<=60": 55, "61-70": 65, "71-80": 75, "81-90": 85, "91-95": 93, ">95": 98}
DTI_MIDPOINTS = {"<=30": 25, "31-36": 33, "37-43": 40, "44-50": 47, ">50": 55}

# Spellings that mean a state's code.
ALIASES = {
    "california": "ca", "new york": "ny", "texas": "tx", "florida": "fl", "arizona": "az", "georgia": "ga",
    "illinois": "il", "michigan": "mi", "north carolina": "nc", "ohio": "oh", "pennsylvania": "pa", "washington": "wa",
}

# What a reader calls the columns.
FEATURE_LABELS = {
    "loan_age_months": "months since origination", "remaining_term_months": "months left on the term", "interest_rate": "interest rate",
    "original_interest_rate": "rate at origination", "original_balance": "original loan amount", "current_balance": "current balance",
    "days_past_due": "days past due", "modification_flag": "loan has been modified", "current_status": "payment status",
    "credit_score_band": "credit score band", "ltv_band": "loan-to-value band", "dti_band": "debt-to-income band", "state": "state",
    "loan_purpose": "loan purpose", "occupancy_type": "occupancy type", "property_type": "property type", "servicer_name": "servicer",
    "document_status": "document status", "source_system": "source system", "vintage": "origination year", "original_term_months": "original term",
    "balance_ratio": "share of the original balance still outstanding", "term_progress": "how far through its term the loan is",
    "scheduled_balance_ratio": "balance the payment schedule expects", "amortisation_gap": "distance from the contractual payment schedule",
    "market_rate": "prevailing market rate that month", "rate_incentive": "rate paid above the market rate",
    "rate_incentive_pctile": "refinance incentive versus other loans that month", "months_delinquent_to_date": "months spent delinquent so far",
    "ever_delinquent": "has ever been delinquent", "max_dpd_to_date": "worst delinquency reached",
    "delinquency_streak": "consecutive months currently delinquent", "n_status_changes_to_date": "number of status changes so far",
    "balance_change_3m": "balance movement over the last three months", "ever_modified": "has ever been modified",
    "credit_score_band_ordinal": "credit score", "ltv_band_ordinal": "loan-to-value ratio", "dti_band_ordinal": "debt-to-income ratio",
    "rule_violation_count": "number of validation rules broken", "source_conflict": "servicer feed disagrees with the panel",
    "source_stale": "reporting source updated late", "servicer_update_lag_days": "days between the month and its last update",
    "data_quality_score": "record data-quality score",
}
# What a reader is told about exception types and broken rules.
EXCEPTION_LABELS = {
    "none": "no exception", "balance_inconsistency": "balance rose without a recorded modification",
    "date_invalid": "reporting date precedes the origination date", "document_gap": "documents missing on a closed loan",
    "status_reversal": "loan reported active after reaching a terminal state",
}
RULE_LABELS = {
    "balance_non_increasing": "balance increased with no modification on file", "date_order_valid": "reporting month is earlier than origination",
    "dpd_status_consistency": "days past due does not match the reported status", "terminal_state_immutability": "loan reported active after closing",
    "document_completeness_at_closure": "documents incomplete at closure", "servicer_source_agreement": "servicer feed disagrees with the panel",
    "stale_record": "record updated long after the month it describes",
}

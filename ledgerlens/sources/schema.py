"""Fixed schemas of the warehouse tables. Nothing is inferred; money is double, codes are strings."""

from __future__ import annotations

from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "date": DateType()}


def _schema(text: str) -> StructType:
    """Needs no session, unlike Spark's own parser."""
    return StructType([StructField(n, _KINDS[k]) for n, k in (f.split() for f in text.split(", "))])


LOANS = _schema(
    "loan_number string, date_approved date, processing_method string, borrower_name string, borrower_address string, borrower_city string, borrower_state string, borrower_zip string, loan_status string, loan_status_date date, term int, sba_guaranty_pct double, initial_approval_amount double, current_approval_amount double, undisbursed_amount double, franchise_name string, servicing_lender_name string, servicing_lender_state string, rural_urban_indicator string, business_age_description string, project_county_name string, project_state string, project_zip string, jobs_reported double, naics_code string, race string, ethnicity string, gender string, veteran string, nonprofit string, business_type string, originating_lender string, originating_lender_state string, utilities_proceed double, payroll_proceed double, mortgage_interest_proceed double, rent_proceed double, refinance_eidl_proceed double, health_care_proceed double, debt_interest_proceed double, forgiveness_amount double, forgiveness_date date"
)
FRAUD_CASES = _schema("case_id string, loan_number string, defendant_name string, business_name string, alleged_amount double, charge_date date, source string, source_url string, match_method string, match_confidence double")
PRESS_RELEASES = _schema("id string, source string, url string, title string, published_date date, program string, alleged_amount double, body string")
ESTABLISHMENTS = _schema("zip string, naics string, establishments int")
NAICS_TITLES = _schema("naics_code string, title string")
SIGNALS = _schema("loan_number string, detector_id string, score double, evidence_json string")

TABLES = {"loans": LOANS, "fraud_cases": FRAUD_CASES, "press_releases": PRESS_RELEASES, "establishments": ESTABLISHMENTS, "naics_titles": NAICS_TITLES, "signals": SIGNALS}
KEYS = {"loans": ["loan_number"], "press_releases": ["id"], "establishments": ["zip", "naics"], "naics_titles": ["naics_code"], "fraud_cases": ["case_id"]}

#: Raw loan file header of each warehouse column whose name isn't the column's in camel case.
RAW_HEADERS = {
    "sba_guaranty_pct": "SBAGuarantyPercentage", "nonprofit": "NonProfit", "naics_code": "NAICSCode",
    **{c: c.upper() for c in ("utilities_proceed", "payroll_proceed", "mortgage_interest_proceed", "rent_proceed", "refinance_eidl_proceed", "health_care_proceed", "debt_interest_proceed")},
}


def raw_header(column: str) -> str:
    return RAW_HEADERS.get(column) or "".join(w.capitalize() for w in column.split("_"))

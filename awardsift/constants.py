"""Word lists, names, codes and column maps that results depend on."""

# --- fixed values: keyword lists -------------------------------------------------------------
DEI_WORDS = [
    "DEI", "diversity", "equity", "inclusion", "gender", "civil rights", "non-binary",
    "environmental justice", "sustainability", "resilience", "empowerment", "inclusive", "justice",
    "social justice", "racial justice", "gender justice", "female", "indigenous", "LGBT", "literacy",
    "education", "poverty", "humanitarian",
]
NGO_WORDS = [
    "environmental justice", "sustainability", "green", "climate", "NGO", "non-profit", "charity",
    "shell company", "foreign aid", "low-income", "disadvantaged", "non government organization",
    "foundation", "institution", "institute", "consulting", "support", "training", "consulting",
    "capacity building", "technical assistance", "management", "operational costs",
    "strategic planning", "miscellaneous expenses", "innovation", "empowerment",
    "community development", "outreach", "engagement", "awareness", "partnership", "collaboration",
    "initiatives", "pass-through", "subcontract", "emergency funding", "discretionary",
    "unallocated", "reimbursement", "pilot project", "startup costs", "overhead", "third-party",
    "newly established", "emerging organization", "grassroots", "rapid deployment", "seed funding",
    "non-competitive", "sole source", "humanitarian aid", "foreign assistance", "advocacy",
]
WASTE_WORDS = [
    "support", "assistance", "aid", "help", "backing", "resources", "provision", "maintenance",
    "sustainment", "upkeep", "clerical", "administrative", "office support", "paperwork", "filing",
    "record keeping", "data entry", "secretarial", "coordination", "logistics", "mail", "mailing",
    "distribution", "correspondence", "delivery", "shipping", "postage", "communication",
    "messaging", "dissemination", "consult", "consulting", "advisory", "advice", "guidance",
    "counsel", "expertise", "input", "recommendations", "consultancy", "training", "workshop",
    "seminar", "facilitate", "facilitation", "education", "instruction", "orientation",
    "development", "capacity", "meeting", "conference", "travel", "event", "retreat", "promotion",
    "publicity", "materials", "supplies", "miscellaneous",
]

# --- fixed values: department names and their acronyms ---------------------------------------
DEPARTMENTS = {
    "Department of Agriculture": "USDA",
    "Department of Commerce": "DOC",
    "Department of Defense": "DOD",
    "Department of Education": "ED",
    "Department of Energy": "DOE",
    "Department of Health and Human Services": "HHS",
    "Department of Homeland Security": "DHS",
    "Department of Housing and Urban Development": "HUD",
    "Department of Justice": "DOJ",
    "Department of Labor": "DOL",
    "Department of State": "DOS",
    "Department of the Interior": "DOI",
    "Department of the Treasury": "TREAS",
    "Department of Transportation": "DOT",
    "Department of Veterans Affairs": "VA",
    "Environmental Protection Agency": "EPA",
    "National Aeronautics and Space Administration": "NASA",
    "Small Business Administration": "SBA",
    "Office of Personnel Management": "OPM",
    "General Services Administration": "GSA",
    "Social Security Administration": "SSA",
}

# --- fixed values: award types and the codes that belong to each -----------------------------
AWARD_TYPES = ["contracts", "grants"]
AWARD_TYPE_CODES = {
    "contracts": ["A", "B", "C", "D", "IDV_A", "IDV_B", "IDV_B_A", "IDV_B_B", "IDV_B_C", "IDV_C", "IDV_D", "IDV_E"],
    "grants": ["02", "03", "04", "05", "06"],
}

# --- fixed values: raw dump column -> standard column ----------------------------------------
CONTRACT_COLUMNS = {
    "award_id_piid": "piid",
    "prime_award_base_transaction_description": "description",
    "current_total_value_of_award": "value",
    "period_of_performance_current_end_date": "end_date",
    "recipient_name": "vendor",
    "awarding_agency_name": "agency",
}
GRANT_COLUMNS = {
    "award_id_fain": "piid",
    "prime_award_base_transaction_description": "description",
    "total_obligated_amount": "value",
    "period_of_performance_current_end_date": "end_date",
    "recipient_name": "vendor",
    "awarding_agency_name": "agency",
}
END_DATE_COLUMNS = ["period_of_performance_current_end_date", "period_of_performance_end_date"]
DESCRIPTION_COLUMNS = [
    "prime_award_base_transaction_description", "description", "award_description", "prime_award_project_description",
]

# --- fixed values: placeholder texts ---------------------------------------------------------
PLACEHOLDER_IDS = ["Unavailable", "Charge Card Purchase"]
PLACEHOLDER_VENDORS = ["Unavailable", "DOMESTIC AWARDEES (UNDISCLOSED)"]
UNKNOWN = "Unknown"

# --- fixed values: column order of the review file and columns both tables must keep ---------
REVIEW_COLUMNS = ["piid", "description", "value", "vendor", "agency", "end_date", "anomaly_score", "for_review"]
ESSENTIAL_COLUMNS = ["piid", "agency", "vendor", "value", "description", "clean_description", "normalized_value"]

# --- fixed values: texts that stand for "no value" in a CSV file -------------------------------
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
]

SORT_COLUMN = {"savings": "date", "payments": "post_date"}

"""Code lists and constants that results depend on, stated as they are."""

# Countries of each sales region; any other country, or none, is OTHER.
REGION_COUNTRIES = {
    "NA": ["US", "CA", "MX"],
    "EMEA": ["DE", "FR", "GB", "IT", "ES", "NL", "BE", "PL", "CZ"],
    "APAC": ["CN", "JP", "IN", "KR", "AU", "SG", "TH"],
    "LATAM": ["BR", "AR", "CL", "CO"],
}
OTHER_REGION = "OTHER"

# segment code, segment name, company code, sort order
SEGMENTS = [
    ("HAD", "Aerospace & Defense", "1100", 1),
    ("HPA", "Process Automation", "1200", 2),
    ("HSB", "Smart Buildings", "1300", 3),
    ("HET", "Energy Transition", "1400", 4),
    ("CORP", "Corporate", "1900", 5),
    ("CONSOL", "Group (Consolidated)", None, 0),
]

# Purchase-request status codes.
REQUEST_STATUS = {"B": "released", "L": "cancelled", "N": "open"}

# Days allowed by each payment term.
PAYMENT_TERMS_DAYS = {"Net15": 15, "Net30": 30, "Net45": 45, "Net60": 60}

# Spend taxonomy: parent code and name, then (leaf code, leaf name, account, account type, segment).
SPEND_TAXONOMY = [
    ("Direct_Materials_Components", "Direct Materials & Components", [
        ("Aerospace_Components", "Aerospace Components", "5000", "COGS", "HAD"),
        ("Hydraulic_Systems", "Hydraulic Systems", "5000", "COGS", "HAD"),
        ("Composite_Materials", "Composite Materials", "5000", "COGS", "HAD"),
        ("Industrial_Sensors", "Industrial Sensors", "5000", "COGS", "HPA"),
        ("Control_Systems", "Control Systems", "5000", "COGS", "HPA"),
        ("HVAC_Equipment", "HVAC Equipment", "5000", "COGS", "HSB"),
        ("Building_Controls", "Building Controls", "5000", "COGS", "HSB"),
        ("Security_Systems", "Security Systems", "5000", "COGS", "HSB"),
        ("Fire_Suppression", "Fire Suppression", "5000", "COGS", "HSB"),
        ("Solar_Components", "Solar Components", "5000", "COGS", "HET"),
        ("Battery_Materials", "Battery Materials", "5000", "COGS", "HET"),
        ("Power_Electronics", "Power Electronics", "5000", "COGS", "HET"),
    ]),
    ("Raw_Materials", "Raw Materials", [
        ("Raw_Materials_Metals", "Raw Materials — Metals", "5000", "COGS", "CROSS"),
        ("Raw_Materials_Polymers", "Raw Materials — Polymers", "5000", "COGS", "CROSS"),
    ]),
    ("MRO_Field_Services", "MRO & Field Services", [
        ("MRO_Services_Aero", "MRO Services — Aero", "5030", "COGS", "HAD"),
        ("Calibration_Services", "Calibration Services", "5030", "COGS", "HPA"),
    ]),
    ("Software_Cloud", "Software & Cloud", [
        ("Process_Software", "Process Software", "6040", "SGA", "HPA"),
        ("Monitoring_Software", "Monitoring Software", "6040", "SGA", "HET"),
        ("Cloud_Infrastructure", "Cloud Infrastructure", "6050", "SGA", "CROSS"),
    ]),
    ("IT_Telecom", "IT & Telecom", [
        ("IT_Services", "IT Services", "6050", "SGA", "CROSS"),
        ("Telecommunications", "Telecommunications", "6110", "SGA", "CROSS"),
    ]),
    ("Professional_Services", "Professional Services", [
        ("Professional_Services_Legal", "Professional Services — Legal", "6060", "SGA", "CROSS"),
        ("Professional_Services_Audit", "Professional Services — Audit", "6070", "SGA", "CROSS"),
        ("Professional_Services_Consulting", "Professional Services — Consulting", "6080", "SGA", "CROSS"),
    ]),
    ("Facilities_GA", "Facilities & G&A", [
        ("Office_Supplies", "Office Supplies", "6100", "SGA", "CROSS"),
        ("Facilities", "Facilities", "6090", "SGA", "CROSS"),
        ("Travel", "Travel", "6020", "SGA", "CROSS"),
        ("Marketing", "Marketing", "6030", "SGA", "CROSS"),
        ("Training", "Training", "6130", "SGA", "CROSS"),
    ]),
    ("Logistics", "Logistics", [
        ("Logistics_Freight", "Logistics & Freight", "6120", "SGA", "CROSS"),
    ]),
]

# Account types that make up the profit-and-loss actuals.
INCOME_ACCOUNT_TYPES = ["REVENUE", "COGS", "SGA", "RD", "INTEREST", "TAX"]

# Budget growth on the previous quarter, and the loading on base salary.
REVENUE_GROWTH, OTHER_GROWTH = "1.03", "1.02"
SALARY_LOADING = "1.30"

# Expected conversion along request -> order -> invoice, and gate tolerances.
REQUEST_TO_ORDER, ORDER_TO_INVOICE = 0.80, 0.80
HARD_TOLERANCE, LOOSE_TOLERANCE, JOURNAL_TOLERANCE = 0.02, 0.15, "0.01"

# Supplier flags.
MAVERICK_THRESHOLD, MANAGED_CONFIDENCE = 0.15, 0.75

# Bins of supplier propensity: upper bound (exclusive) and label; the last label is the rest.
PROPENSITY_BINS = [
    (0.05, "00-05 (clean)"), (0.10, "05-10"), (0.15, "10-15"),
    (0.20, "15-20 (eval slice)"), (0.25, "20-25"),
]
PROPENSITY_REST = "25+ (very maverick)"

# Calendar range, open end of a version, missing-category marker.
CALENDAR_START, CALENDAR_END = "2023-01-01", "2027-12-31"
OPEN_END = "9999-12-31"
MISSING = "__NA__"

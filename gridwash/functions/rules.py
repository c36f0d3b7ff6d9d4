"""Fixed values of the cleaning and scoring rules.

Patterns, word lists, weights and thresholds are data, kept together so that
the Column code in the other modules only composes them.
"""

from __future__ import annotations

# --- fixed values: white space removed by a strip -------------------------------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)

def padded(pattern: str) -> str:
    """A whole-text pattern that also allows white space around the text.

    Saves the strip: one pass over the text and one reference to the column.
    """
    blanks = f"[{STRIP_CHARS}]*"
    return f"^{blanks}(?:{pattern.removeprefix('^').removesuffix('$')}){blanks}$"


# --- fixed values: cell formats (pattern, description, example) ------------------
FORMATS = {
    "date": (r"^\d{2}/\d{2}/\d{4}$", "DD/MM/YYYY", "25/12/2024"),
    "pan": (r"^[A-Z]{5}[0-9]{4}[A-Z]{1}$", "AAAAA9999A", "ABCDE1234F"),
    "gst": (
        r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[0-9]{1}[Z]{1}[0-9A-Z]{1}$",
        "99AAAAA9999A9Z9",
        "27AABCU9603R1ZP",
    ),
    "phone": (
        r"^(\+91[-\s]?)?[6-9]\d{9}$",
        "+91-9999999999 or 9999999999",
        "+91-9876543210",
    ),
    "email": (
        r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
        "email@domain.com",
        "user@example.com",
    ),
    "pincode": (r"^\d{6}$", "6 digits", "110001"),
    "aadhaar": (r"^\d{4}\s?\d{4}\s?\d{4}$", "XXXX XXXX XXXX", "1234 5678 9012"),
    "ifsc": (r"^[A-Z]{4}0[A-Z0-9]{6}$", "AAAA0999999", "SBIN0001234"),
    "vehicle": (
        r"^[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{1,2}[\s-]?\d{4}$",
        "AA 99 AA 9999",
        "DL 01 AB 1234",
    ),
    "percentage": (r"^\d{1,3}(\.\d{1,2})?%?$", "0-100 with optional decimal", "18.5%"),
    "currency_inr": (r"^₹?\s?\d{1,3}(,\d{3})*(\.\d{2})?$", "₹ 1,234.56", "₹ 12,345.67"),
}

# --- fixed values: words in a column name that name its format, first hit wins ---
NAME_WORDS = (
    ("date", ("date", "dt", "day", "month", "year")),
    ("pan", ("pan", "pan_card", "pancard")),
    ("gst", ("gst", "gstin", "gst_no", "gst_number")),
    ("phone", ("phone", "mobile", "contact", "tel")),
    ("email", ("email", "mail", "e-mail")),
    ("pincode", ("pin", "pincode", "zip", "postal")),
    ("aadhaar", ("aadhaar", "aadhar", "uid")),
    ("ifsc", ("ifsc", "bank_code")),
    ("vehicle", ("vehicle", "registration", "reg_no")),
    ("percentage", ("percent", "percentage", "rate")),
    ("currency_inr", ("amount", "price", "cost", "total", "sum")),
)

# --- fixed values: content rules on the first 20 values (format, pattern, share) -
CONTENT_RULES = (
    ("date", r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", 0.5),
    ("gst", r"^[0-9]{2}[A-Z]{5}", 0.3),
    ("pan", r"^[A-Z]{5}[0-9]{4}[A-Z]{1}$", 0.3),
    ("phone", r"^[6-9]\d{9}", 0.3),
    ("email", None, 0.3),
)
CONTENT_SAMPLE = 20

# --- fixed values: identifier patterns (pattern, description, example) -----------
PATTERNS = {
    "PAN_CARD": (
        r"^[A-Z]{5}[0-9]{4}[A-Z]{1}$",
        "Indian PAN Card (ABCDE1234F)",
        "ABCDE1234F",
    ),
    "AADHAAR": (r"^\d{4}\s?\d{4}\s?\d{4}$", "Indian Aadhaar (12 digits)", "1234 5678 9012"),
    "GST_NUMBER": (
        r"^\d{2}[A-Z]{5}\d{4}[A-Z]{1}[A-Z\d]{1}[Z]{1}[A-Z\d]{1}$",
        "Indian GST Number",
        "29ABCDE1234F1Z5",
    ),
    "INDIAN_MOBILE": (
        r"^(\+91[\-\s]?)?[6-9]\d{9}$",
        "Indian Mobile Number",
        "+91-9876543210",
    ),
    "PINCODE": (r"^[1-9][0-9]{5}$", "Indian Pincode (6 digits)", "560001"),
    "IFSC_CODE": (r"^[A-Z]{4}0[A-Z0-9]{6}$", "Bank IFSC Code", "SBIN0001234"),
    "VEHICLE_NUMBER": (
        r"^[A-Z]{2}[\s\-]?\d{1,2}[\s\-]?[A-Z]{1,2}[\s\-]?\d{1,4}$",
        "Indian Vehicle Number",
        "KA 01 AB 1234",
    ),
    "EMAIL": (
        r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
        "Email Address",
        "user@example.com",
    ),
    "US_SSN": (r"^\d{3}-?\d{2}-?\d{4}$", "US Social Security Number", "123-45-6789"),
    "US_PHONE": (
        r"^(\+1[\-\s]?)?\(?\d{3}\)?[\-\s]?\d{3}[\-\s]?\d{4}$",
        "US Phone Number",
        "+1 (555) 123-4567",
    ),
    "UK_POSTCODE": (r"^[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}$", "UK Postcode", "SW1A 1AA"),
    "PASSPORT": (r"^[A-Z][0-9]{7}$", "Indian Passport Number", "A1234567"),
    "DATE_YYYY_MM_DD": (r"^\d{4}[-/]\d{2}[-/]\d{2}$", "Date (YYYY-MM-DD)", "2024-01-15"),
    "DATE_DD_MM_YYYY": (r"^\d{2}[-/]\d{2}[-/]\d{4}$", "Date (DD-MM-YYYY)", "15-01-2024"),
    "CREDIT_CARD": (
        r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
        "Credit Card Number",
        "1234 5678 9012 3456",
    ),
    "ISBN": (r"^(97[89])?\d{9}(\d|X)$", "ISBN Number", "9781234567890"),
    "IPV4": (r"^(\d{1,3}\.){3}\d{1,3}$", "IPv4 Address", "192.168.1.1"),
    "PERCENTAGE": (r"^\d{1,3}(\.\d{1,2})?%?$", "Percentage Value", "85.50%"),
    "CURRENCY_INR": (
        r"^₹?\s?\d{1,3}(,\d{3})*(\.\d{2})?$",
        "Indian Rupee Amount",
        "₹ 1,234.56",
    ),
    "CURRENCY_USD": (
        r"^\$?\s?\d{1,3}(,\d{3})*(\.\d{2})?$",
        "US Dollar Amount",
        "$1,234.56",
    ),
}
PATTERN_SAMPLE = 100
PATTERN_SHARE = 0.6
MISMATCH_SAMPLES = 10

# --- fixed values: number and date tests -----------------------------------------
NUMBER_SYMBOLS = ",$€£"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE_SEARCH = (
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\w+ \d{1,2}, \d{4}",
)
DATE_COLUMN_SEARCH = (
    r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    r"\d{1,2}-\w{3}-\d{2,4}",
    r"\w{3}\s+\d{1,2},?\s+\d{4}",
)
TIME_OF_DAY = r"^\d{1,2}:\d{2}(:\d{2})?$"
NULL_TOKENS = ("NULL", "null", "#N/A", "N/A", "n/a", "#NA")

# --- fixed values: header tests ---------------------------------------------------
GENERIC_HEADERS = (r"^Unnamed:", r"^Column_\d+$", r"^\d+$", r"^$")
GENERIC_SHARE = 0.5
DATA_LIKE_SHARE = 0.3
SYMBOLS_ONLY = r"^[0-9\s\-\+\(\)\.\,\$\€\£\%]+$"
LONG_TEXT = 50
LONG_HEADER = 100
HEADER_ROWS = 20

# --- fixed values: quality score --------------------------------------------------
WEIGHTS = {
    "structural_integrity": 0.25,
    "data_completeness": 0.30,
    "data_consistency": 0.15,
    "data_uniqueness": 0.10,
    "format_compliance": 0.05,
    "business_logic": 0.05,
    "header_quality": 0.10,
}
LEVELS = (
    (25, "POOR", "Very poor data quality. Significant issues detected that require attention."),
    (45, "FAIR", "Below average data quality. Some issues present but data can be processed."),
    (65, "GOOD", "Good data quality. Minor issues that can be easily addressed."),
    (80, "VERY_GOOD", "Very good data quality. Well-structured data ready for processing."),
    (None, "EXCELLENT", "Excellent data quality. Premium quality data structure."),
)
ISSUES = (
    ("structural_integrity", 50, "Poor data structure - consider reviewing the data layout"),
    (
        "data_completeness",
        40,
        "Significant missing data - may need data collection improvements",
    ),
    (
        "data_consistency",
        60,
        "Some data type inconsistencies - can be addressed during cleaning",
    ),
    (
        "data_uniqueness",
        50,
        "High level of duplicate data - review if duplicates are intentional",
    ),
    ("format_compliance", 30, "Some format standardization opportunities available"),
    ("business_logic", 60, "Minor data validation points to consider"),
    ("header_quality", 50, "Header quality could be improved"),
)
SUGGESTIONS = (
    (
        "structural_integrity",
        60,
        "Consider reviewing data structure and removing any unnecessary empty sections",
    ),
    (
        "data_completeness",
        50,
        "Address missing values where appropriate - consider data collection or imputation",
    ),
    ("data_consistency", 70, "Some data type standardization could improve consistency"),
    (
        "data_uniqueness",
        60,
        "Review duplicate records to determine if they should be removed or are intentional",
    ),
    (
        "format_compliance",
        50,
        "Consider standardizing date and numeric formats for better consistency",
    ),
    ("business_logic", 70, "Review data for any obvious outliers or inconsistencies"),
    ("header_quality", 60, "Consider improving column headers for better clarity"),
)
SCORE_OUTLIER_IQR = 5.0
FLAG_OUTLIER_IQR = 1.5
SCORE_BANDS = {
    "display": ((40, "low"), (70, "medium"), (None, "high")),
    "colour": ((60, "red"), (80, "yellow"), (None, "green")),
    "file": (
        (30, "garbage"),
        (50, "poor"),
        (70, "fair"),
        (85, "good"),
        (None, "excellent"),
    ),
}

# --- fixed values: usage prices (per million tokens) and event limits -------------
PRICES = (("a", 3.0, 15.0), ("b", 30.0, 60.0))
LIMITS = {
    "requests": (60, "1 minute"),
    "ai_calls": (20, "1 minute"),
    "uploads": (100, "1 hour"),
}

# --- fixed values: texts of suggestions (description, action, impact) -----------------
SUGGESTION_TEXTS = {
    "missing": (
        "Column '%s' has %.1f%% missing values",
        "Consider dropping column '%s' or imputing values",
        "Affects %.1f%% of rows",
    ),
    "padding": (
        "Column '%s' contains leading/trailing whitespace",
        "Trim whitespace from all values",
        "Improves data consistency",
    ),
    "case": (
        "Column '%s' has inconsistent text case",
        "Standardize text case",
        "Reduces unique values from %d to %d",
    ),
    "dates": (
        "Column '%s' appears to contain dates as text",
        "Convert to datetime format",
        "Enables date operations and sorting",
    ),
    "numbers": (
        "Column '%s' contains numbers stored as text",
        "Convert to numeric type",
        "Enables numeric operations",
    ),
    "single": (
        "Column '%s' contains only one unique value",
        "Consider dropping this column",
        "Reduces redundant data",
    ),
    "repeats": (
        "Remove %d duplicate rows",
        "Drop duplicate rows keeping first occurrence",
        "Removes %d rows",
    ),
}
# --- fixed values: lines of the file-clean log ------------------------------------------
CLEAN_LOG = {
    "loaded": "Loaded table with shape: ({rows}, {columns})",
    "rows": "Removed {n} completely empty rows",
    "columns": "Removed {n} completely empty columns",
    "header": "Used row {k} as headers, removed {k} rows (header + rows above)",
    "no_header": "Generated column names (no header row detected)",
    "names": "Cleaned {n} column names",
    "trimmed": "Trimmed whitespace from text values",
    "format": "Standardized '{column}' as {kind} format",
    "dates": "Standardized '{column}' to YYYY/MM/DD date format",
    "nulls": "Standardized NULL representations to NaN",
    "changed": "Warning: Column count changed from {before} to {after}",
}

# --- fixed values: lines of the issue list, in its order --------------------------------
ISSUE_TEXTS = {
    "missing": "Column '%s' has %.1f%% missing values",
    "single": "Column '%s' has only one unique value",
    "padding": "Column '%s' has leading/trailing whitespace",
    "repeats": "Found %d duplicate rows",
    "dates": "Column '%s' appears to contain dates stored as text",
    "numbers": "Column '%s' appears to contain numbers stored as text",
}

# --- fixed values: advice for a column whose values do not all match --------------------
MISMATCH_TEXT = (
    "Column '%s' appears to contain %s but %d values don't match the expected format. "
    "Review these values for data entry errors."
)

# --- fixed values: shapes of dates that become day/month/year ---------------------------
DATE_SHORT_YEAR = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})$"
DATE_YEAR_FIRST = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
DATE_DAY_FIRST = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
DATE_ONE_MARK = (r"^\d+-\d+-\d+$", r"^\d+/\d+/\d+$")

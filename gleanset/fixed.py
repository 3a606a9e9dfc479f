"""Patterns, word lists, labels and seeds that decide results."""

# ── Character classes and patterns ──────────────────────────────────────────
# Whitespace as a text "strip" understands it.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters removed from a column, by semantic type.
UNWANTED_CHARS = {
    "numeric": r"[^\d]",
    "phone": r"[^\d+]",
    "email": r"[^a-zA-Z0-9@._\-]",
    "url": r"[^a-zA-Z0-9:/._\-?=&]",
    "text": r"(?U)[^a-zA-Z0-9\s\-'.&]",
}
UNWANTED_CHARS_OTHER = r"(?U)[^a-zA-Z0-9\s]"

EMAIL_FORMAT = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
URL_FORMAT = r"^(https?://)?(www\.)?[A-Za-z0-9\-]+\.[A-Za-z]{2,}(\S*)?$"
PHONE_DIGITS = r"^\d{7,15}$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

CURRENCY_PREFIX = r"^[₹$€£¥\s]*(?:Rs\.?|USD|EUR|GBP|INR|AUD|CAD)?\s*"
AMOUNT = r"([\d,]+\.?\d*)"
# unit spellings of normalize_currency, and their multipliers by first letter
CURRENCY_UNITS = r"lakhs?|lacs?|l|crores?|cr|c|billions?|b|bn|millions?|m|mn|thousands?|k"
# unit spellings of the median / mean parser
SHORTHAND_PREFIX = r"^[₹$€£¥\s]*(?:Rs\.?\s*)?"
SHORTHAND_UNITS = r"l|lac|lacs|lakh|lakhs|cr|crore|crores|k|m|mn"
UNIT_FACTORS = {
    "l": 100_000.0, "c": 10_000_000.0, "b": 1_000_000_000.0, "m": 1_000_000.0, "t": 1_000.0, "k": 1_000.0,
}
# number words of the standalone dedup key, tried in this order
NUMBER_WORDS = {"thousand": 1000.0, "hundred": 100.0, "million": 1000000.0, "lakh": 100000.0}

ALIASED_MAIL_DOMAINS = ["gmail.com", "googlemail.com", "yahoo.com", "hotmail.com"]

# shape -> timestamp patterns accepted for it
DATE_SHAPES = {
    r"^\d{4}-\d{2}-\d{2}$": ["yyyy-MM-dd"],
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$": ["yyyy-MM-dd HH:mm"],
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$": ["yyyy-MM-dd HH:mm:ss"],
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$": ["yyyy-MM-dd'T'HH:mm:ss"],
    r"^\d{1,2}/\d{1,2}/\d{4}$": ["d/M/yyyy", "M/d/yyyy"],
    r"^\d{2}-\d{2}-\d{4}$": ["dd-MM-yyyy", "MM-dd-yyyy"],
    r"^\d{1,2} [A-Za-z]{3} \d{4}$": ["d MMM yyyy"],
    r"^[A-Za-z]{3} \d{1,2}, \d{4}$": ["MMM d, yyyy"],
    r"^\d{4}/\d{1,2}/\d{1,2}$": ["yyyy/M/d"],
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": ["d.M.yyyy"],
    r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$": ["MMMM d, yyyy"],
    r"^\d{1,2} [A-Za-z]{4,9} \d{4}$": ["d MMMM yyyy"],
    r"^\d{8}$": ["yyyyMMdd"],
    # fractions of a second and zones: read by the ISO cast
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}((\.\d{1,9})(Z|[+-]\d{2}:\d{2})?|Z|[+-]\d{2}:\d{2})$": [],
}

# ── Semantic typing ─────────────────────────────────────────────────────────
INFERENCE_PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"^\+?\d{7,15}$",
    "url": r"^(https?://)?(www\.)?[A-Za-z0-9-]+\.[A-Za-z]{2,}(\S*)?$",
}
INFERENCE_HIT_RATE = 0.6
INFERENCE_DATE_RATE = 0.8

IDENTIFIER_KEYWORDS = [
    "id", "user_id", "userid", "record_id", "transaction_id", "serial", "sno", "rownum",
    "row_number", "index", "serial no.", "sno.", "s no.", "sn", "s.no", "serial number",
]
IDENTIFIER_KEYWORDS_ALT = [
    "id", "user_id", "customer_id", "employee_id", "account_id", "serial", "serial_no",
    "s_no", "sno", "record_id", "s.no",
]

# alias group -> (semantic type, aliases); first group that holds a name wins
COLUMN_ALIASES = {
    "email": ("email", [
        "email", "email address", "e-mail", "mail", "email id", "e mail", "work email",
        "personal email"]),
    "phone": ("phone", [
        "phone", "phone number", "mobile", "mobile number", "contact number", "cell",
        "cell number", "telephone", "tel", "whatsapp", "fax", "work phone", "home phone",
        "alt phone", "alternate number", "contact", "alternate phone"]),
    "url": ("url", [
        "website", "linkedin", "linkedin url", "website url", "profile link", "website link",
        "linkedin link", "profile url", "instagram", "twitter", "faecbook", "github",
        "portfolio", "social", "social media", "link", "fb", "x", "handle"]),
    "name": ("text", [
        "name", "full name", "first name", "last name", "fname", "lname", "given name",
        "surname", "middle name", "display name", "contact name", "alias"]),
    "company": ("text", [
        "comapny", "company name", "organization", "organization name", "organisation",
        "organisation name", "employer", "firm", "business", "brand", "account name",
        "client name", "client"]),
    "id": ("numeric", ["id", "user id", "employee id", "customer id"]),
    "date": ("date", [
        "dob", "birthday", "birth date", "date", "created at", "created date", "date created",
        "creation date", "signup date", "joined date", "registration date", "updated at",
        "modified date", "last updated", "closed date", "due date", "deadline", "expiry date",
        "appointment date", "scheduled date", "start date", "end date"]),
}

# ── Fuzzy duplicates ────────────────────────────────────────────────────────
FUZZY_THRESHOLD = 0.92

# ── Master record layout ────────────────────────────────────────────────────
MASTER_LABELS = {
    "first_name": "First Name",
    "last_name": "Last Name",
    "email_address": "Email Address",
    "primary_phone_number": "Primary Phone Number",
    "alternate_phone_number": "Alternate Phone Number",
    "company_name": "Company Name",
    "job_title": "Job Title",
    "department": "Department",
    "website_url": "Website URL",
    "address_line_1": "Address Line 1",
    "address_line_2": "Address Line 2",
    "city": "City",
    "state_province": "State / Province",
    "postal_zip_code": "Postal / ZIP Code",
    "country": "Country",
    "linkedin_profile_url": "LinkedIn Profile URL",
    "industry": "Industry",
    "lead_source": "Lead Source",
    "record_status": "Record Status",
    "date_of_birth": "Date of Birth",
    "gender": "Gender",
    "company_size": "Company Size",
    "annual_revenue": "Annual Revenue",
}
SYSTEM_COLUMNS = ("id", "file_id", "custom_fields", "created_at", "updated_at", "imported_by")
NULL_WORDS = ("nan", "nat", "null")

# ── Record search ───────────────────────────────────────────────────────────
SEARCH_COLUMNS = [
    "first_name", "last_name", "email_address", "primary_phone_number", "company_name",
    "job_title", "department", "city", "state_province", "country", "industry",
    "lead_source", "imported_by",
]
CLIENT_SEARCH_COLUMNS = [
    "first_name", "last_name", "email_address", "company_name", "city", "country", "industry",
]
FIELD_SYNONYMS = {
    "email": "email_address",
    "phone": "primary_phone_number",
    "company": "company_name",
    "state": "state_province",
    "zip": "postal_zip_code",
    "status": "record_status",
}
IMPORT_SYNONYMS = {
    "first_name": ["first_name", "First Name"],
    "last_name": ["last_name", "Last Name"],
    "email_address": ["email_address", "email", "Email"],
    "primary_phone_number": ["primary_phone_number", "phone", "Phone"],
    "company_name": ["company_name", "company", "Company"],
    "job_title": ["job_title", "Job Title"],
    "department": ["department"],
    "city": ["city", "City"],
    "state_province": ["state_province", "state"],
    "country": ["country", "Country"],
    "industry": ["industry", "Industry"],
    "record_status": ["record_status", "status"],
}
EXPORT_ROWS = 50_000

# ── Activity log ────────────────────────────────────────────────────────────
LOG_FILTERS = {
    "login": ["%Logged in%", "%Logged out%", "%Failed login%", "%Session expired%"],
    "cleaning": ["%Uploaded file%", "%Cleaned file%", "%Downloaded file%", "%Removed file%",
                 "%Saved preset%", "%Loaded preset%"],
    "import": ["%Uploaded file%", "%Ingested%"],
    "clean": ["%Cleaned file%"],
    "export": ["%Exported%"],
    "search": ["Searched:%"],
}
ROLE_QUOTAS = {"admin": 1_000_000, "manager": 100_000}
DEFAULT_QUOTA = 50_000
LOGIN_FAILURES = 5
LOGIN_WINDOW_SECONDS = 600

ISSUE_LABELS = {
    "validate_not_empty": "Blank required field",
    "handle_missing": "Blank required field",
    "duplicate_identifier": "Duplicates flagged",
    "fuzzy_duplicate": "Duplicates flagged",
    "duplicate_removal": "Duplicates flagged",
    "validate_email": "Format errors",
    "validate_email_domain": "Format errors",
    "validate_phone": "Format errors",
    "validate_url": "Format errors",
    "validate_numeric": "Format errors",
    "validate_date": "Format errors",
}

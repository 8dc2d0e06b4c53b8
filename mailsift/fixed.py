"""Word lists, thresholds, patterns and formats that results depend on."""

# --- fixed values: null tokens and fills -------------------------------------------------
NULL_TOKENS = ["na", "NA", "Unknown", ""]
UNKNOWN = "unknown"
NO_LINKS = "none"
DEFAULT_DATE = "2000-01-01 00:00:00"
DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
]

# --- fixed values: keyword lists ---------------------------------------------------------
URGENCY_BATCH = [
    "urgent", "immediate", "action required", "verify",
    "suspended", "expired", "confirm", "alert",
]
URGENCY_SINGLE = URGENCY_BATCH + ["attention", "security", "warning"]
FINANCIAL_BATCH = [
    "bank", "account", "payment", "credit", "paypal",
    "transaction", "invoice", "refund",
]
FINANCIAL_SINGLE = FINANCIAL_BATCH + ["wire", "transfer"]
PERSONAL = ["password", "social security", "ssn", "pin", "cvv"]

# --- fixed values: url patterns ----------------------------------------------------------
SUSPICIOUS_URL = r"(?i)(bit\.ly|tinyurl|shorturl|goo\.gl|t\.co)"
SHORTENERS = r"(?i:bit\.ly|tinyurl|goo\.gl)"

# --- fixed values: character classes -----------------------------------------------------
# White space as Unicode-aware text tools see it; spelled out, so every regex engine agrees.
WS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# --- fixed values: feature names ---------------------------------------------------------
APP_FEATURES = [
    "subject_length", "subject_num_special", "subject_upper_words",
    "body_length", "body_word_count", "body_num_digits",
    "body_num_exclaim", "body_num_question", "num_urls", "has_url",
    "urgency_score", "financial_score",
]
CORRELATED_FEATURES = [
    "subject_length", "body_length", "num_urls", "urgency_score",
    "financial_score", "subject_num_special", "body_num_exclaim",
    "body_num_digits", "body_percent_caps",
]

# --- fixed values: threat levels and texts -----------------------------------------------
THREAT_LEVELS = [(0.9, "CRITICAL"), (0.75, "HIGH"), (0.5, "MEDIUM"), (0.25, "LOW")]
THREAT_FLOOR = "SAFE"
THREAT_TEXTS = [
    ("CRITICAL", "CRITICAL THREAT", "Extremely high risk. Delete immediately."),
    ("HIGH", "HIGH RISK", "Strong phishing indicators detected."),
    ("MEDIUM", "SUSPICIOUS", "Multiple suspicious indicators."),
    ("LOW", "LOW RISK", "Minor concerns detected."),
    ("SAFE", "SAFE", "No significant threats."),
]
KEY_FACTORS = [
    ("Urgency Keywords", "urgency_score"),
    ("Financial Terms", "financial_score"),
    ("URL Count", "num_urls"),
    ("Special Characters", "subject_num_special"),
    ("Exclamation Marks", "body_num_exclaim"),
]

INDICATORS = [
    ("content", "Subject Length", "subject_length"),
    ("content", "Body Length", "body_length"),
    ("content", "Word Count", "body_word_count"),
    ("content", "URLs Found", "num_urls"),
    ("risk", "Urgency Score", "urgency_score"),
    ("risk", "Financial Keywords", "financial_score"),
    ("risk", "Personal Info", "personal_info_score"),
    ("risk", "Suspicious URLs", "has_ip_url + has_url_shortener"),
]
VERDICTS = ("Phishing", "Safe")
HISTORY_HEADINGS = {
    "timestamp": "Timestamp",
    "subject": "Subject",
    "sender": "Sender",
    "probability": "Threat Score",
    "is_phishing": "Status",
    "model": "Model",
}

# --- fixed values: learning and privacy parameters ---------------------------------------
SEED = 42
IMBALANCE_GATE = 0.67
EPSILONS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]
DATA_NORM = 10.0
MIN_NOISE_EPSILON = 0.01
N_ORGANISATIONS = 5

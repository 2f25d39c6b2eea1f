"""Word lists, tables and patterns whose content decides results. No logic here."""

# --- Fixed values: scale words and what they multiply by.
SCALES = {
    "thousand": 1e3, "k": 1e3,
    "lakh": 1e5, "lac": 1e5, "lakhs": 1e5,
    "million": 1e6, "mn": 1e6, "mln": 1e6, "m": 1e6,
    "crore": 1e7, "cr": 1e7, "crores": 1e7,
    "billion": 1e9, "bn": 1e9, "b": 1e9,
    "trillion": 1e12, "tn": 1e12,
}

# --- Fixed values: currency marks, longest first, and their codes.
CURRENCY_MARKS = [
    ("rupees", "INR"), ("rs.", "INR"), ("inr", "INR"), ("us$", "USD"), ("usd", "USD"), ("eur", "EUR"), ("gbp", "GBP"),
    ("rs", "INR"), ("₹", "INR"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"),
]
CURRENCY_SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}

# --- Fixed values: patterns of numbers and values (Java and Python read them alike).
NUMBER = r"\(?-?\d{1,3}(?:,\d{2,3})*(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?"
PERCENT = r"%|\bper\s*cent\b|\bpercent\b"
NUMERIC_CELL = r"^[₹$€£]?\s*\(?-?\d[\d,]*(?:\.\d+)?\)?\s*[%+]?$"
FOOTNOTE_CELL = r"^\(\d\)$"
VALUE = (
    r"(₹|Rs\.?|INR|US\$|\$|€|£)?\s*(\(?-?\d[\d,]*(?:\.\d+)?\)?)\s*"
    r"(thousand|lakhs?|lac|crores?|cr|billion|bn|million|mn|mln|trillion|tn|K|Mn|Cr|Bn)?\s*(%|per\s*cent|percent)?"
)
MONEY_OR_PERCENT = r"(?:₹|Rs\.?|INR|US\$|\$|€|£)\s*\d|(?:\d[\d,]*(?:\.\d+)?)\s*(?:crore|cr|lakh|million|mn|billion|bn|per\s*cent|percent|%)"
PAGE_SCALE = (
    r"(?:amounts?|figures?|values?|₹|rs\.?|inr)?\s*(?:are\s+)?(?:in|:)\s*(?:₹|rs\.?|inr|us\$|\$)?\s*"
    r"(million|lakhs?|lac|crores?|thousand|billion)s?|(?:₹|rs\.?|inr)\s*(million|lakhs?|crores?|billion)"
)
LABEL_SCALES = ["crore", "cr", "lakh", "million", "mn", "billion", "bn", "thousand"]

# --- Fixed values: patterns of periods.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE = rf"({MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})|(\d{{1,2}})\s+({MONTH})\.?,?\s+(\d{{4}})"
QUARTER = r"\bQ([1-4])\s*[:\-]?\s*(?:FY)?\s*(\d{2,4})(?:\s*[-/]\s*(\d{2,4}))?"
YEAR_SPAN = r"\b(?:FY|F\.Y\.?|fiscal(?:\s+year)?)?\s*(\d{4}|\d{2})\s*[-/]\s*(\d{2,4})\b"
FISCAL_YEAR = r"\b(?:FY|F\.Y\.?|fiscal(?:\s+year)?)\s*[:\-]?\s*(\d{4}|\d{2})\b"
MONTHS_ENDED = r"(\w+)?\s*months?\s+ended\s+(.+)"
YEAR_ENDED = r"(?:for\s+the\s+)?year\s+ended\s+(.+)"
AS_OF = r"as\s+(?:of|at|on)\s+(.+)"
CALENDAR_YEAR = r"\b(?:19|20)\d{2}\b"
PERIOD_AFTER_VALUE = (
    r"^\s*(?:for|in|during|as of|as at|of)?\s*(FY\s*\d{2,4}(?:[-/]\d{2,4})?|Q[1-4]\s*FY?\s*\d{2,4}|\d{4}[-/]\d{2,4}|"
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}|\d{4})"
)
DOCUMENT_FISCAL_YEAR = r"\bFY\s*(\d{2,4})\b"
HEADER_DATE = rf"{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}"
HEADER_QUARTER = r"Q[1-4]\s*[:\-]?\s*(?:FY)?\s*\d{2,4}"
HEADER_FISCAL_YEAR = r"\bFY\s*\d{2,4}(?:\s*[-/]\s*\d{2,4})?\b"
HEADER_WORDS = (
    r"fiscal\s+year|year\s+ended|fy\s+ended|months?\s+ended|period\s+ended|as\s+of\s+and\s+for|for\s+the\s+year|as\s+at|"
    r"as\s+of\s+the\s+end|standalone|consolidated"
)

FISCAL_HEADER = r"fiscal|year\s+ended\s+march\s+31"
MONTHS_HEADER = r"months?\s+ended|period\s+ended"
CUE_REACH = 30

# --- Fixed values: cues of status and scope, in the order in which they are tried.
STATUS_CUES = [
    ("estimate", ["estimated", "estimate", "advance estimate", "provisional", "first advance", "second advance", "projected to", "is expected to"]),
    ("forecast", ["projected", "forecast", "outlook", "expected to grow", "is projected", "baseline scenario"]),
    ("revised", ["revised estimate", "revised", "re:", " re "]),
    ("budget", ["budget estimate", "budgeted", " be:", " be "]),
    ("actual", ["actual", "stood at", "recorded", "reported", "grew by", "moderated to", "rose by", "increased to", "as against"]),
]
SCOPE_CUES = [("consolidated", ["consolidated"]), ("standalone", ["standalone", "stand-alone", "stand alone"])]

# --- Fixed values: sentences.
LINKING_VERBS = (
    r"\b(?:stood at|amounted to|totall?ed|came in at|was|were|is|are|reached|grew by|grew|rose by|rose|increased to|increased by|"
    r"decreased to|declined to|moderated to|estimated to grow by|estimated to be|estimated at|is estimated|is projected at|"
    r"projected at|projected to|expected to grow by|expected to be|registered a|recorded|grow by)\b"
)
LEADING_WORDS = [
    "and", "but", "the", "our", "your", "its", "a", "an", "as", "on", "in", "for", "during", "of", "to", "with", "however", "moreover",
    "further", "additionally", "meanwhile", "accordingly", "thus", "therefore", "while", "although", "though", "based on", "according to", "note that",
]
SENTENCE_BREAK = r"(?<=[.;])\s+(?=[A-Z(₹\"])"
TILE_NOISE = r"\bYoY\b|\bQoQ\b|\(\d\)|[:•]|\bvs\.?\b"
POSSESSIVE = r"^\s*([A-Z][a-zA-Z]+)(?:'s|’s)\b"
SUBJECT = r"^\s*([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})\s+(?:reported|posted|recorded|registered|had|has|grew|rose)"
GROWTH = r"grow|growth|expand|rose|ris(?:e|ing)|increas|moderat|contract|declin|accelerat|slow"

# --- Fixed values: entities.
LEGAL_SUFFIXES = ["limited", "ltd", "inc", "plc", "corporation", "corp", "company", "co", "llp", "llc", "group", "holdings"]
LEGAL_NAME = r"\b([A-Z][A-Za-z&.\-]+(?:\s+[A-Z][A-Za-z&.\-]+){0,3})\s+(?:Limited|Ltd|Inc|PLC|Corporation|LLP|LLC)\b"
PROPER_NOUN = r"\b([A-Z][a-z]{2,})(?:['’]s)?\b"
GENERIC_NAMES = [
    "the company", "the group", "the bank", "the corporation", "the firm", "the issuer", "we", "our company",
    "the organisation", "the organization", "us", "it",
]
NO_SUBJECT = [
    "The", "This", "In", "As", "For", "During", "Note", "Table", "Chart", "Source", "Figure", "March", "December", "June", "September",
    "January", "April", "May", "July", "August", "October", "November", "February", "Fiscal", "Total", "Revenue", "India's", "Our", "Its",
    "Annual", "Report", "Quarter", "Financial", "Year", "Company", "Limited", "Reserve", "Board",
]
NO_ENTITY = [
    "Source", "Chart", "Table", "Figure", "Note", "Notes", "Data", "Growth", "Inflation", "Food", "Prices", "Sector", "Economic", "Survey",
    "Bank", "Government", "Report", "Annual", "Fund", "Staff", "Board", "Committee", "Gross", "Domestic", "Product", "Fiscal", "Policy",
    "Market", "Global", "Real", "Total", "Capital", "Current", "Account", "Services", "Trade", "Exports", "Imports", "Fixed", "Rate",
    "Rates", "Index", "Consumer", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec", "January",
    "February", "April", "June", "July", "August", "September", "October", "November", "December", "Private", "Public", "Reserve", "Mudran",
    "Corporation", "Company", "Institute", "Association", "Authority", "Ministry", "Department",
]
NO_HINT = [
    "annual", "report", "excerpt", "prospectus", "presentation", "earnings", "survey", "economic", "consultation", "article", "iv", "fy",
    "fy24", "fy25", "q1", "q2", "q3", "q4", "final", "draft", "the", "and", "for", "of", "pdf", "reserve", "bank", "fund", "international",
    "monetary", "limited", "ltd",
]

# --- Fixed values: attributes. Heads in the order in which they are tried.
PERIOD_WORDS = r"\bfy\s*\d{2,4}\b|\bq[1-4]\b|\b(?:19|20)\d{2}\b|\bfiscal\b|\bquarter\b|\byear\b"
SCOPE_WORDS = ["consolidated", "standalone", "stand-alone", "combined"]
FILLER_WORDS = [
    "the", "of", "for", "a", "an", "our", "your", "in", "on", "at", "total", "restated", "real", "nominal", "gross", "net", "overall",
]
FAMILY_HEADS = [
    (r"gross\s+domestic\s+product|gdp", "gdp"),
    (r"gross\s+value\s+added|gva", "gva"),
    (r"revenues?\s+from\s+operations|revenues?\s+from\s+services|revenues?\s+from\s+contracts|revenues?\s+from\s+customers|total\s+income\s+from\s+operations|turnover|revenues?", "revenue"),
    (r"ebitda\s+margin", "ebitda margin"),
    (r"adjusted\s+ebitda", "adjusted ebitda"),
    (r"ebitda", "ebitda"),
    (r"other\s+income", "other income"),
    (r"total\s+income", "total income"),
    (r"net\s+worth", "net worth"),
    (r"profit\s+after\s+tax|pat|net\s+profit", "profit after tax"),
    (r"loss\s+for\s+the\s+period|loss\s+for\s+the\s+year|net\s+loss", "net loss"),
    (r"team\s+size", "team size"),
    (r"head\s*count", "headcount"),
    (r"work\s*force", "workforce"),
    (r"number\s+of\s+employees|no\.?\s+of\s+employees|employees", "employees"),
    (r"partner\s+agents", "partner agents"),
    (r"active\s+customers", "active customers"),
    (r"cpi[\s-]*iw|cpi\s+for\s+industrial\s+workers|industrial\s+workers", "cpi-iw inflation"),
    (r"consumer\s+price\s+inflation|headline\s+cpi|cpi\s+inflation|retail\s+inflation|cpi", "cpi inflation"),
    (r"wholesale\s+price|wpi", "wpi inflation"),
    (r"food\s+inflation", "food inflation"),
    (r"core\s+inflation", "core inflation"),
    (r"fiscal\s+deficit", "fiscal deficit"),
    (r"current\s+account\s+deficit|cad", "current account deficit"),
    (r"shipments?", "shipments"),
    (r"tonnage|tonnes?|tons?", "tonnage"),
]
TOTAL_REVENUE = [
    "revenue", "revenues", "turnover", "total revenue", "total revenues", "revenue from operations", "revenues from operations",
    "revenue from services", "revenues from services", "revenue from contracts", "revenues from contracts",
    "revenue from contracts with customers", "revenues from contracts with customers", "revenue from customers",
    "revenues from customers", "total revenue from customers", "total income from operations",
]
MONETARY_FAMILIES = ["revenue", "ebitda", "adjusted ebitda", "total income", "other income", "net worth", "profit after tax", "net loss", "fiscal deficit", "current account deficit"]
COUNT_FAMILIES = ["team size", "headcount", "workforce", "employees", "partner agents", "active customers", "shipments", "tonnage"]
PERCENT_FAMILIES = ["gdp growth", "gva growth", "cpi inflation", "wpi inflation", "food inflation", "core inflation", "ebitda margin"]
NO_METRIC = [
    "and", "or", "others", "other", "the", "of", "for", "to", "with", "in", "on", "at", "as", "by", "a", "an", "is", "are", "was", "were",
    "it", "this", "that", "these", "those", "which", "such", "per", "cent", "percent", "total", "further", "however", "moreover", "also",
    "thus", "therefore", "from", "less", "add", "plus", "minus", "includes", "including", "net", "gross", "sub", "note", "remarks",
    "particulars",
]

# --- Fixed values: accounting identities, a result and its components.
IDENTITIES = [("total income", ["revenue", "other income"])]

# --- Fixed values: how notes on two values and differences of context are written.
NOTE_UNITS = "different units (%s vs %s)"
NOTE_ROUNDING = "within rounding tolerance (Δ=%s ≤ %s)"
NOTE_RELATIVE = "within relative tolerance (%.3f%% ≤ %.3f%%)"
NOTE_DIFFER = "values differ by %.2f%% (Δ=%s)"
DIFFERENT_VALUES = "different {what} (%s vs %s)"
DIFFERENT_DEFINITIONS = "different metric definitions"

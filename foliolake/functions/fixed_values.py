"""Constants that decide results and therefore must be exactly these.

Patterns, word lists, weights and limits are stated here as plain text, in
natural order.  Nothing in this module is logic.
"""

# --- whitespace as str.strip()/str.split() see it -------------------------------------------
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- paging and chunking ---------------------------------------------------------------------
PAGE_TARGET_CHARS = 2000
PAGE_MIN_CHARS = 300
SECTION_MIN_CHARS = 200
CHUNK_CHARS = 3200
CHUNK_OVERLAP = 800
CHUNK_MIN_CHARS = 200
SEGMENT_PAGE_SECONDS = 30.0
SECTION_BREAK = r"(?:\n\s*\n)|(?:\n\s*(?:\d+\.|[A-Z]{2,}\.)\s)|(?:\n\s*[-=]{3,}\s*\n)"
SENTENCE_END = r"[.!?]\s+"

# --- personal-data patterns ------------------------------------------------------------------
PII_PHONE = r"\b(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
EMAIL_ADDRESS = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
PII_SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"
PII_DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\w+ \d{1,2},? \d{4})\b"
PII_ADDRESS = (
    r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}"
    r"(?:St|Street|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Ln|Lane|Rd|Road|Ct|Court|Way|Pl|Place)\b"
)
PII_CONFIDENCE = {"phone": 0.9, "email": 0.95, "ssn": 0.85, "dob": 0.75, "address": 0.7}
BIRTH_KEYWORDS = ["born", "birth", "dob", "d.o.b", "age", "birthday"]
BIRTH_CONTEXT = 200
SSN_CONTEXT = 50
PHONE_CONTEXT = 30
DIGIT_RUN = "12345678901234567890"
URL_MARK = r"https?://"
ID_STAMP = r"[A-Z]{2,}\d{5,}"

# --- regex entities --------------------------------------------------------------------------
ENTITY_PATTERNS = {
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "EMAIL_ADDR": EMAIL_ADDRESS,
    "ACCOUNT": r"(?i)\b(?:account|acct|a/c)[\s#:]*\d{4,}\b",
    "ADDRESS": (
        r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}"
        r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl)\b"
    ),
}
ENTITY_CONFIDENCE = 0.85

# --- link confidence -------------------------------------------------------------------------
SIGNAL_WEIGHTS = {
    "ner_match": 0.25,
    "direct_scan": 0.20,
    "title_mention": 0.30,
    "bates_match": 0.15,
    "metadata_match": 0.10,
}
EDGE_WEIGHTS = {"co-occurrence": 1.0, "co-passenger": 2.0, "correspondence": 1.5}

# --- duplicate detection ---------------------------------------------------------------------
IDENTIFIER_TITLE = r"^[A-Za-z]{1,10}[\-_]?\d{3,}$"
NUMBERED_ID = r"^([A-Z]+)(\d+)"

# --- search ----------------------------------------------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
QUERY_SYMBOLS = r"[?!;:@#$%^&*()\[\]{}<>~/\\|`]"
QUERY_STOP_WORDS = [
    "who", "what", "where", "when", "why", "how", "is", "are", "was", "were", "the", "a", "an",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "do", "does", "did", "can", "could",
    "would", "should", "this", "that", "it",
]
NAMED_DOCUMENT_IDS = [r"\bEFTA\d{8}\b", r"\beml-[0-9a-f]{8,12}\b"]

# --- file families ---------------------------------------------------------------------------
SCAN_FAMILIES = {
    "pdf": ["pdf"],
    "media": ["mp3", "mp4", "m4a", "m4v", "wav", "flac", "ogg", "avi", "mov", "wmv", "webm", "mkv", "vob", "ts"],
    "text": ["txt", "md", "csv", "html", "htm", "json", "xml"],
    "office": ["doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp"],
}
STUB_IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp", "heic"]
TEXT_INGEST_EXTENSIONS = ["txt", "md", "csv", "html"]

# document-type label: first rule that holds wins; (label, tag fragments, extensions)
DOCUMENT_TYPES = [
    ("PDF", ["pdf"], ["pdf"]),
    ("Email", ["eml", "email", "msg"], ["eml", "msg"]),
    ("Transcript", ["transcript", "whisper"], ["vtt", "srt"]),
    ("Spreadsheet", ["xlsx", "xls", "csv"], ["xlsx", "csv"]),
    ("Word", ["docx", "doc"], ["docx", "doc"]),
    ("Slides", ["pptx", "ppt"], ["pptx"]),
    ("HTML", ["html", "htm"], ["html", "htm"]),
    ("Image", ["image", "png", "jpg", "jpeg"], []),
    ("Video", ["mp4", "mov", "webm", "video"], []),
    ("Text", ["txt", "md"], ["txt", "md"]),
]
MEDIA_FORMATS = {
    "mp4": "MP4 Video", "webm": "WebM Video", "mov": "MOV Video", "avi": "AVI Video", "mkv": "MKV Video",
    "mp3": "MP3 Audio", "wav": "WAV Audio", "ogg": "OGG Audio", "flac": "FLAC Audio", "aac": "AAC Audio",
    "m4a": "M4A Audio", "wma": "WMA Audio",
}
CAPTION_SECTIONS = ["PEOPLE", "TEXT", "OBJECTS", "SETTING", "ACTIVITY", "NOTABLE"]
EMAIL_HEADERS = ["From", "To", "CC", "BCC", "Subject", "Date"]
GEOCODE_SUFFIXES = [", dc", ", md", ", va", ", fl", ", ca", ", ny", ", tx"]

# --- history ---------------------------------------------------------------------------------
HISTORY_HEADER = "[Prior investigation context — earlier conversation turns condensed]\n"
HISTORY_ACK = "Understood. I have the prior investigation context from earlier in this conversation."

# --- entity noise ----------------------------------------------------------------------------
NUMERIC_ENTITY_TYPES = ["DATE", "TIME", "CARDINAL", "ORDINAL", "PERCENT", "MONEY", "QUANTITY", "LANGUAGE"]
LOCATION_ENTITY_TYPES = ["GPE", "LOC", "LOCATION"]

HEADER_WORDS = [
    "tel", "fax", "subject", "from", "to", "cc", "bcc", "date", "re", "fw", "fwd", "via", "attn",
]
COMPANY_AND_TITLE_WORDS = [
    "html", "llc", "ltd", "corp", "inc", "co", "llp", "esq", "mr", "mrs", "ms", "dr", "prof", "sir", "hon",
]
MAIL_FOOTERS = [
    "update profile/email address", "unsubscribe", "privacy policy", "read more", "view online",
    "sent from my iphone", "sent from my ipad", "click here", "see more",
]
FEED_PHRASES = [
    "stock quotes", "market data and analysis", "global business and financial news", "digital products",
    "real-time", "real time", "xa9", "breaking news", "morning squawk", "nj 07632 data",
    "the daily news e-edition", "twitter", "facebook", "instagram", "linkedin", "youtube",
]
LONE_FIRST_NAMES = [
    "jeffrey", "peter", "john", "david", "james", "michael", "robert", "tom", "bob", "william", "richard",
    "thomas", "charles", "george", "mark", "paul", "joe", "bill", "andrew", "chris", "eric", "adam", "alan",
    "alex", "brian", "jason", "virginia", "kevin", "ryan", "scott", "steven", "timothy", "sarah", "biden",
    "jack", "jim", "frank", "henry", "ted", "ned", "sam", "dan", "tim", "rob",
]
PANDEMIC_WORDS = ["covid", "covid-19", "coronavirus", "omicron", "delta", "alpha", "beta"]
PLACE_STUBS = ["view", "hackettstown", "nj", "ny", "ca", "tx", "fl"]
SHIPPING_WORDS = ["shipped", "delivered", "pending", "processing"]
SHIPPING_PHRASES = ["shipment total", "help department", "critical", "floor"]
POSTSCRIPT_WORDS = ["p.s.", "ps", "nb", "n.b."]
ADDRESS_SUFFIXES = ["Ave", "St", "Blvd", "Rd", "Dr", "Lane", "Way", "Pkwy"]
DIRECTORY_SYMBOLS = ["{", "}", "<", ">", "•", "▪", "■", "✓", "♦", "≥", "*", "@"]
GRAPH_NODE_SYMBOLS = ["{", "}", "<", ">", "/", "*", "@", "http", "=", ";"]
GRAPH_EDGE_SYMBOLS = ["{", "}", "<", ">", "/", "@", "http", "="]

# The letters of the Western single-byte code between 80 and 9F, and the bytes they stand at.
WESTERN_LETTERS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WESTERN_CONTROLS = "".join(chr(b) for b in (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F))

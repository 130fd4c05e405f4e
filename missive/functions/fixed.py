"""Patterns, phrase lists, lookup tables and texts that results depend on."""

# Patterns of sensitive values; the group is the value. (type, pattern, ignore case)
OTP = r"\b(?:otp|one[\s-]?time\s*(?:password|passcode|code)?|verification\s+code|security\s+code|auth(?:entication)?\s*code)\b[^0-9A-Za-z]{0,6}(?:is|:|=)?[^0-9A-Za-z]{0,6}(\d{4,8}(?:-\d{1,3})?)(?=\b)"
PASSWORD = r"\b(?:pass(?:word|code|wd)|pwd)\b\s*(?:(?:is|are)\s*|[:=]\s*)?([^\s.,;:!?]+)"
PIN = r"\b(?:pin(?!\s*code\b)|atm\s*pin|upi\s*pin)\s*(?:number)?\s*(?:is\s*|[:=]\s*)?(\d{4,8}(?:-\d{1,3})?)(?=\b)"
TOKEN = r"\b(?:access\s+token|auth(?:entication)?\s+token|api\s*key|secret\s*key|token)\b\s*(?:(?:is|are)\s*|[:=]\s*)?([^\s.,;:!?]+)"
TOKEN_PREFIX = r"\b((?:sk-|pk-|rk-|ghp_|gho_|ghu_|xox[bap]-|tok_)[A-Za-z0-9_-]{6,})\b"
JWT = r"\b(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{6,})\b"
RECOVERY = r"\b(?:account\s+recovery\s+code|recovery\s+code|backup\s+code|reset\s+code|recovery\s+key)\b\s*(?:(?:is|are)\s*|[:=]\s*)?([^\s.,;:!?]+)"
CARD = r"\b(?:card\s*(?:number|no)|credit\s*card|debit\s*card)\b[^0-9A-Za-z]{0,6}(?:is|:|=)?[^0-9A-Za-z]{0,6}(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:-\d{1,3})?|\d{13,19}(?:-\d{1,3})?)(?=\b)"
CARD_BARE = r"\b(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:-\d{1,3})?)\b"
BANK = r"\b(?:bank\s+account(?:\s+number)?|account\s+number|account\s+no|a\s*/\s*c\s+no|savings\s+account)\b\s*(?:is|:|=)?\s*(\d{9,18}(?:-\d{1,3})?)"
UPI = r"\b(?:upi(?:\s+(?:id|address|number))?|phonepe|google\s*pay|gpay|paytm|bhim)\b\s*(?:is|:|=)?\s*([A-Za-z0-9._-]{2,}@[A-Za-z][A-Za-z0-9_.-]*)"
UPI_BARE = r"\b([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})(?!\.\w)\b"
PHONE = r"\b(?:call(?:\s+me)?(?:\s+(?:at|on))?|contact(?:\s+me)?(?:\s+(?:at|on))?|reach(?:\s+me)?\s+at|phone(?:\s+number)?|mobile(?:\s+number)?|whatsapp(?:\s+number)?|cell(?:\s+number)?)\b\s*(?:is\s*|[:=]\s*)?([+()\d][\d\s()-]{7,19})"
EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
EMAIL_CONTEXT = r"my\s*(?:personal\s*)?(?:e-?mail|mail)\b|e-?mail\s+id|e-?mail\s+address|personal\s+e-?mail|contact\s+me|reach\s+me|mail\s+me|e-?mail\s+me|send\s+it\s+to|write\s+to\s+me|this\s+is\s+my|reachable\s+at"
ADDRESS = r"\b(?:(?:my|home|my\s+home|residential|my\s+residential|private)\s+address|my\s+residence|residing\s+at|i\s+live\s+at|i\s+stay\s+at|my\s+place)\b\s*(?:is|:|=)?\s*([^.;!?\n]+)"
PAN = r"\b([A-Z]{5}\d{4}[A-Z])\b"
AADHAAR = r"\b(?:aadhaar|aadhar|uid\s*number|12[\s-]?digit\s*(?:id|number))\b\s*(?:is|:|=)?\s*(\d{4}\s*\d{4}\s*\d{4}|\d{12})(?=\b)"
PASSPORT = r"\b(?:passport(?:\s+(?:number|no))?)\b\s*(?:is|:|=)?\s*([A-Z]\d{7}|[A-Z]\d{8}|[A-Z]\d{7}[A-Z])"
GENERIC_ID = r"\b(?:id\s+number|id\s+no|identification\s+number|id\s+card|identity\s+(?:number|card)|ssn|social\s+security(?:\s+number)?|voter\s*id|driving\s+licen[cs]e|driver'?s\s+licen[cs]e|licen[cs]e\s+number)\b\s*(?:is|:|=)?\s*([A-Z0-9][A-Z0-9 -]{3,})"
HEALTH = r"\b(?:test\s+result|blood\s+(?:report|test|pressure|sugar)|diagnos\w*|prescription|medical\s+(?:report|history|condition)|vitamin\s+[A-Z]|allerg\w*|diabet\w*|thyroid|cholesterol|haemoglobin|hemoglobin|sugar\s+level|mental\s+health|depression|anxiety|cancer|pregnancy|hiv\b|std\b|fever|surgery|heart\s+(?:disease|condition))\b"
CVV = r"\b(?:cvv|cvc)\b\s*(?:is\s*|[:=]\s*)?(\d{3,4})(?=\b)"
OTHER = r"\b(?:security\s+question|net\s*banking\s*password|banking\s+password|login\s+(?:details|password|credentials?)|credentials?|seed\s+phrase|private\s+key|wallet\s+key|backup\s+phrase|master\s+password|wifi\s+password|router\s+password)\b\s*(?:(?:is|are)\s*|[:=]\s*)?(:?[^\s.,;!?]+)"
CLAUSE_END = r"[.;!?\n]"
PLAIN_WORD = r"^[a-z][a-z'-]*$"
STARS = r"^\*{4,}$"
REDACTED = r"^\[REDACTED"
PHONE_DIGITS = (10, 13)
LUHN_DIGITS = 13
EMAIL_WINDOW = 80
MAIL_DOMAINS = ("gmail", "yahoo", "hotmail", "outlook", "icloud", "aol", "protonmail", "rediffmail", "live", "msn", "zoho", "yandex")

# Mask (null: stars), risk and advice of each type of sensitive value.
SENSITIVE_TYPES = {
    "one_time_password": (None, "high", "Do not share the one-time password; treat it as compromised if forwarded."),
    "password": (None, "high", "Rotate the password and enable two-factor authentication."),
    "pin": (None, "high", "Do not share the PIN; change it immediately if exposed."),
    "authentication_token": ("[REDACTED_TOKEN]", "high", "Revoke the token and rotate the related credentials."),
    "account_recovery_code": (None, "high", "Keep recovery codes offline; regenerate them if exposed."),
    "payment_card_number": (None, "high", "Do not store the full card number; contact the issuer if compromised."),
    "bank_account_number": (None, "high", "Mask the account number and monitor the account for unusual activity."),
    "upi_payment_identifier": (None, "medium", "Do not share UPI identifiers; enable app lock and transaction alerts."),
    "private_phone_number": ("[REDACTED_PHONE]", "medium", "Mask the personal number and share it only with trusted parties."),
    "private_email": ("[REDACTED_EMAIL]", "medium", "Avoid sharing personal email addresses in public channels."),
    "private_address": ("[REDACTED_ADDRESS]", "medium", "Mask the residential address; do not share it in public messages."),
    "identification_number": ("[REDACTED_ID]", "high", "Protect the identification number and report suspected misuse."),
    "health_information": ("[REDACTED_HEALTH]", "high", "Keep health details confidential and share only with medical staff."),
    "other_sensitive_credential": ("[REDACTED]", "high", "Protect this credential; rotate or revoke it if it may be exposed."),
}

# Phrases and patterns of the classifier.
ACTION_PHRASES = (
    "please submit", "please review", "please update", "please reply", "please confirm", "please send", "please share", "please call",
    "please arrange", "please provide", "please approve", "please help", "please let me know", "please make sure", "please join",
    "need you to", "submit by", "complete by", "reply by", "respond by", "due on", "is due", "deadline", "remember to", "don't forget",
    "dont forget", "renew the", "pay the", "review the", "update the", "fix the", "check the", "verify the", "sign the", "send the",
    "submit the", "complete the", "approve the", "share the", "fill the", "make sure to", "email the", "send it",
)
WEAK_ACTION_PHRASES = ("can you", "could you", "are you able to", "are you available")
MEETING_NOUNS = (
    "calendar", "dinner", "lunch", "seminar", "workshop", "interview", "briefing", "orientation", "appointment", "stand-up", "standup",
    "catch-up", "catchup", "retreat", "conference", "celebration", "scheduled", "schedule", "demo", "event", "session", "meeting", "sync",
    "huddle",
)
WEAK_MEETING_NOUNS = ("meet", "review", "reunion", "gathering")
MEETING_CONTEXT = r"\b\d{4}-\d{2}-\d{2}\b|\bat\s+\d{1,2}:\d{2}\b|\bat\s+\d{1,2}\s*(?:am|pm)\b|\btomorrow\b|\bnext\s+week\b|\bhappens\s+on\b|\bmeeting\s+room\b|\bconference\s+room\b|\bauditorium\b|\btraining\s+hall\b|\bmain\s+office\b|\bcity\s+clinic\b|\blocation:?\b|\bthe\s+library\b|\bclassroom\b"
ACTION_DEADLINE = r"\b(?:by|before)\s+\d{4}-\d{2}-\d{2}\b|\bdeadline\b|\bdue\s+on\b|\bis\s+due\b|\basap\b"
PROMO_PHRASES = (
    "discount", "sale", "offer", "deal", "coupon", "cashback", "promotion", "exclusive", "limited time", "buy one", "free delivery",
    "free shipping", "reward points", "flash sale", "festival", "weekend sale", "premium plan", "student plan",
    "upgrade your subscription", "subscribe", "buy now", "shop now", "save 30%", "save 25%", "% off", "get 25%", "get 50%", "use code",
    "you may like", "earn reward points",
)
PERSONAL_PHRASES = (
    "my favourite", "my favorite", "my preference", "i prefer", "i might prefer", "i like", "i love", "i usually", "i always", "i drink",
    "i use dark mode", "my t-shirt size", "my shirt size", "my shoe size", "personal note", "for my profile", "my birthday", "my diet",
    "my hobby", "my favourite language", "emergency contact", "just so you know, i", "remember that i", "my age", "my hometown",
    "i was born", "i am vegetarian", "i am a vegetarian", "i prefer morning meetings", "i prefer evening meetings", "i play", "i read",
    "i want to", "i hope to",
)
CATEGORY_REASONS = {
    "meeting_or_event": "Meeting or event with schedule, date, time or location signals.",
    "action_required": "Request for action: task verb, direct ask or deadline.",
    "promotional": "Promotional content: offer, sale or promo code.",
    "personal_information": "Personal fact, preference or profile detail.",
    "general_information": "Informational statement without action, event or offer.",
}
SENSITIVE_REASON = "Detected sensitive content; value masked before any external processing."
CATEGORIES = ("action_required", "meeting_or_event", "personal_information", "promotional", "sensitive_information", "general_information")
CONFIDENCE_FLOOR, GENERAL_CONFIDENCE, HIGH_RISK_CONFIDENCE, OTHER_RISK_CONFIDENCE = 0.65, 0.5, 0.97, 0.92

# Grammar of dates, times and scheduled items.
TIME = r"\d{1,2}(?::\d{2})?\s*(?:am|pm)?"
DATE = r"(?:\d{4}-\d{2}-\d{2}|(?:(?:today|tomorrow|yesterday)|(?:(?:next|this)\s+)?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|in\s+(?:a\s+day|\d+\s+days?|(?:one|two|three|four|five|six|seven|eight|nine|ten)\s+days?)))"
CALENDAR = rf"calendar\s+update:\s*([^,]+?)\s*,\s*({DATE})\s+at\s+({TIME})(?:\s*,\s*([^.!?\n]+))?"
REMINDER = rf"reminder:\s*([^,]+?)\s+happens\s+on\s+({DATE})\s+at\s+({TIME})\s+in\s+([^.!?\n]+)"
SCHEDULED = rf"the\s+([^,]+?)\s+is\s+scheduled\s+for\s+({DATE})\s+at\s+({TIME})\s+in\s+([^.!?\n]+)"
JOIN = rf"please\s+join\s+the\s+([^,]+?)\s*(?:on\s+)?({DATE})\s*(?:,|at)?\s*({TIME})\s+at\s+([^.!?\n]+)"
AVAILABLE = rf"are\s+you\s+available\s+for\s+the\s+([^,]+?)\s+at\s+({TIME})\s*(?:on\s+)?({DATE})\s*\??\s*(?:location:\s*([^.!?\n]+))?"
CALENDAR_NO_TIME = rf"calendar\s+update:\s*([^,]+?)\s*,\s*({DATE})(?:\s*,\s*([^.!?\n]+))?"
REMINDER_NO_TIME = rf"reminder:\s*([^,]+?)\s+happens\s+on\s+({DATE})(?:\s+in\s+([^.!?\n]+))?"
SCHEDULED_NO_TIME = rf"the\s+([^,]+?)\s+is\s+scheduled\s+for\s+({DATE})(?:\s+in\s+([^.!?\n]+))?"
DEADLINE = rf"\b(?:deadline\s+is|is\s+due\s+on|due\s+on|by|before)\s+({DATE})\b"
CALL_NAME = r"\b(?:please\s+)?(?:call|contact|reach\s+out\s+to)\s+([A-Z][a-z]+)\b"
HIGH_PRIORITY = r"\b(?:urgent|asap|critical|immediately|as\s+soon\s+as\s+possible)\b"
LOW_PRIORITY = r"\b(?:no\s+rush|no\s+hurry|no\s+urgency|when\s+you\s+are\s+free|whenever|at\s+your\s+convenience|when\s+you\s+have\s+time)\b"
PREFIX = r"^(?:for\s+today\s*:?\s*|quick\s+update\s*:?\s*|fyi\s*:?\s*|important\s*:?\s*|can\s+you\s+help\s*\??\s*|please\s+note\s*:?\s*|one\s+more\s+thing\s*:?\s*|just\s+checking[\s—-]*|hi\s*,?\s*)"
SOFTENER = r"^(?:please\s+|could\s+you\s+please\s+|can\s+you\s+please\s+|can\s+you\s+|could\s+you\s+|are\s+you\s+able\s+to\s+|i\s+need\s+you\s+to\s+|i\s+would\s+like\s+you\s+to\s+|i'?d\s+like\s+you\s+to\s+|don'?t\s+forget\s+to\s+|do\s+not\s+forget\s+to\s+|make\s+sure\s+to\s+|remember\s+to\s+|kindly\s+|please\s+make\s+sure\s+to\s+)"
CONNECTIVE = r"^(?:and\s+|also\s+|then\s+|plus\s+)"
CLAUSE_MARKS = " \t.,;:!?\"'()[]"
VALUE_MARKS = " \t.,;:!?”“\"'()[]"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
NO_ITEMS_REASON = "No actionable or schedulable signal detected."
#: Around the number of items.
MODEL_ITEMS_REASON = ("LLM fallback extracted ", " item(s).")
ITEM_TYPES = ("task", "meeting", "event", "reminder")
PRIORITIES = ("high", "medium", "low", "unknown")
#: Text values that the input counts as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

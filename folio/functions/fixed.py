"""What results depend on to be right. Kept as plain tables in their natural order."""

from __future__ import annotations

# fixed values: voices by provider (id, name, gender, tier)
VOICES = {
    "google": [
        ("en-US-Neural2-A", "Emma", "Female", "neural"), ("en-US-Neural2-C", "Brian", "Male", "neural"), ("en-US-Neural2-D", "Jenny", "Female", "neural"),
        ("en-US-Neural2-E", "Davis", "Male", "neural"), ("en-US-Neural2-F", "Clara", "Female", "neural"), ("en-US-Neural2-G", "Jason", "Male", "neural"),
        ("en-US-Neural2-H", "Tony", "Male", "neural"), ("en-US-Neural2-I", "Nancy", "Female", "neural"), ("en-US-Neural2-J", "Aaron", "Male", "neural"),
    ],
    "polly": [
        ("Joanna", "Joanna", "Female", "standard"), ("Matthew", "Matthew", "Male", "standard"), ("Amy", "Amy", "Female", "standard"), ("Brian", "Brian", "Male", "standard"),
        ("Joey", "Joey", "Male", "standard"), ("Justin", "Justin", "Male", "standard"), ("Kendra", "Kendra", "Female", "standard"), ("Kimberly", "Kimberly", "Female", "standard"),
        ("Salli", "Salli", "Female", "standard"), ("Kevin", "Kevin", "Male", "standard"), ("Stephen", "Stephen", "Male", "standard"),
        ("Emma", "Emma", "Female", "neural"), ("Olivia", "Olivia", "Female", "neural"), ("Aria", "Aria", "Female", "neural"), ("Ayanda", "Ayanda", "Female", "neural"), ("Ivy", "Ivy", "Female", "neural"),
        ("Danielle", "Danielle", "Female", "long-form"), ("Gregory", "Gregory", "Male", "long-form"), ("Burrow", "Burrow", "Male", "long-form"),
    ],
    "elevenlabs": [
        ("pNInz6obpgDQGcFmaJgB", "Adam", "Male", "neural"), ("EXAVITQu4vr4xnSDxMaL", "Bella", "Female", "neural"), ("VR6AewLTigWG4xSOukaG", "Arnold", "Male", "neural"),
        ("TxGEqnHWrfWFTfGW9XjX", "Josh", "Male", "neural"), ("21m00Tcm4TlvDq8ikWAM", "Rachel", "Female", "neural"), ("AZnzlk1XvdvUeBnXmlld", "Domi", "Female", "neural"), ("pqHfZKP75CvOlQylNhV4", "Bill", "Male", "neural"),
    ],
}

# fixed values: models (id, name, provider, most tokens)
MODELS = [
    ("gemini-1.5-flash-8b", "Gemini 1.5 Flash-8B", "gemini", 1048576),
    ("gemini-1.5-pro", "Gemini 1.5 Pro", "gemini", 32768),
    ("gpt-4o-mini", "GPT-4O Mini", "openai", 8192),
    ("gpt-4o", "GPT-4O", "openai", 8192),
]

# fixed values: prices of 1000 tokens (model, input, output, and both beyond TIER_TOKENS)
TIER_TOKENS = 128_000
PRICES = [
    ("gpt-4o", 0.0025, 0.01, 0.0025, 0.01),
    ("gpt-4o-mini", 0.00015, 0.0006, 0.00015, 0.0006),
    ("gpt-4.5", 0.075, 0.15, 0.075, 0.15),
    ("o1", 0.015, 0.06, 0.015, 0.06),
    ("o3-mini", 0.0011, 0.0044, 0.0011, 0.0044),
    ("claude-3.5-sonnet", 0.003, 0.015, 0.003, 0.015),
    ("gemini-1.5-pro", 0.00125, 0.005, 0.0025, 0.01),
    ("gemini-1.5-flash-8b", 0.0000375, 0.00015, 0.000075, 0.0003),
    ("deepseek-v2", 0.0003, 0.0003, 0.0003, 0.0003),
]

# fixed values: free characters a month by provider and tier
FREE_CHARACTERS = [
    ("polly", "standard", 5_000_000), ("polly", "neural", 1_000_000), ("polly", "long-form", 500_000),
    ("google", "standard", 4_000_000), ("google", "neural", 1_000_000),
    ("elevenlabs", None, 20_000),
]

# fixed values: errors in the order in which they are tried (code, any of these, and any of these too)
ERROR_RULES = [
    ("AUTH_ERROR", ["api key", "apikey", "unauthorized", "credentials", "authentication", "invalid key"], []),
    ("RATE_LIMIT_ERROR", ["rate limit", "too many requests", "quota", "throttl"], []),
    ("NETWORK_ERROR", ["network", "connection", "timeout", "dns", "econnrefused", "enotfound"], []),
    ("SERVICE_UNAVAILABLE", ["service unavailable", "503", "502", "internal server error"], []),
    ("INVALID_VOICE", ["voice"], ["not found", "invalid"]),
    ("TEXT_TOO_LONG", ["text too long", "maximum length", "character limit"], []),
    ("INIT_ERROR", ["failed to initialize", "client", "credentials not found"], []),
]

# fixed values: abbreviations that don't end a sentence
ABBREVIATIONS = [
    "Ph.D", "M.D", "Ph.D.", "M.D.", "B.A", "B.A.", "M.A", "M.A.", "B.S", "B.S.", "M.S", "M.S.", "U.S", "U.S.", "U.K", "U.K.",
    "Dr", "Dr.", "Mr", "Mr.", "Mrs", "Mrs.", "Ms", "Ms.", "Prof", "Prof.", "vs", "vs.", "etc", "etc.", "i.e", "i.e.", "e.g", "e.g.",
    "Inc", "Inc.", "Co", "Co.", "Corp", "Corp.", "Ltd", "Ltd.", "St", "St.", "Ave", "Ave.", "Blvd", "Blvd.",
]

# fixed values: last words that don't end a sentence, for the plain chunker
PLAIN_ABBREVIATIONS = [
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Inc", "Ltd", "Co", "Corp", "vs", "etc", "eg", "ie", "al", "et", "cf", "ca", "pp", "Ch", "Sec",
    "Fig", "No", "Vol", "Rev", "Ed", "St", "Ave", "Blvd", "Mt", "Ft",
]

# fixed values: numbers as words, and small Roman numerals
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv"]

"""Word lists, lookup tables, patterns and labels that results depend on.

Nothing in this module is logic. The Column functions beside it say how the
values are used.
"""

# ---------------------------------------------------------------- whitespace
# Fixed value: the characters a browser-style "\s" stands for; Java's is ASCII only.
WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_NOT_BLANK = r"[\t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WS_CHARS = (
    " \t\n\x0B\f\r\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
    "\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
# Fixed value: zero-width characters removed from names.
ZERO_WIDTH = "\u200B\u200C\u200D\uFEFF"

# --------------------------------------------------------------- Devanagari
# Digit row, and the eight letters whose dot below is dropped.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
ASCII_DIGITS = "0123456789"
# One-code-point dotted letters and the two-code-point spelling they stand for.
DOTTED_LETTERS = {
    "\u0958": "\u0915\u093C",
    "\u0959": "\u0916\u093C",
    "\u095A": "\u0917\u093C",
    "\u095B": "\u091C\u093C",
    "\u095C": "\u0921\u093C",
    "\u095D": "\u0922\u093C",
    "\u095E": "\u092B\u093C",
    "\u095F": "\u092F\u093C",
}
# Two-code-point spellings that stay one (composed) letter.
COMPOSED_LETTERS = {
    "\u0928\u093C": "\u0929",
    "\u0930\u093C": "\u0931",
    "\u0933\u093C": "\u0934",
}

# ------------------------------------------------------------ house prefixes
# Labels in front of a house number, tabular and scanned text.
HOUSE_PREFIXES = [
    r"h\.?\s*no\.?",
    r"house\s*no\.?",
    r"म\.?\s*क्र\.?",
    r"मकान\s*नं\.?",
    r"गृह\s*सं\.?",
]
OCR_HOUSE_PREFIXES = [
    r"मकान\s*संख्या",
    r"गृह\s*संख्या",
    r"मकान\s*नं\.?",
    r"म\.?\s*क्र\.?",
    r"House\s*No\.?",
    r"H\.?\s*No\.?",
]
OCR_NAME_PREFIXES = [
    "नाम",
    r"मतदाता\s*का\s*नाम",
    r"निर्वाचक\s*का\s*नाम",
    "Name",
]

# ------------------------------------------------------------- code systems
# Fixed values: (code, prefixes, substrings, whole values), tried in this order.
GENDER_CODES = [
    ("MALE", ["m"], ["पुरुष", "मेल"], ["1"]),
    ("FEMALE", ["f"], ["महिला", "स्त्री", "फीमेल"], ["2"]),
    ("OTHER", [], ["other", "third", "अन्य", "तृतीय"], []),
]
RELATION_CODES = [
    ("FATHER", [], ["fat", "पित"], ["f"]),
    ("HUSBAND", [], ["hus", "पत"], ["h"]),
    ("MOTHER", [], ["mot", "मात"], ["m"]),
    ("OTHER", [], ["oth", "अन्य"], []),
]
# The same two code systems as they appear in extracted JSON items (upper case).
JSON_GENDER_CODES = [
    ("FEMALE", [], ["FEMALE", "महिला", "स्त्री"], ["F"]),
    ("MALE", [], ["MALE", "पुरुष"], ["M"]),
    ("OTHER", [], ["OTHER", "THIRD", "अन्य"], []),
]
JSON_RELATION_CODES = [
    ("FATHER", [], ["FATHER", "पिता"], []),
    ("HUSBAND", [], ["HUSBAND", "पति"], []),
    ("MOTHER", [], ["MOTHER", "माता"], []),
    ("OTHER", [], ["WIFE", "पत्नी"], []),
]

# ------------------------------------------------------ header vocabularies
# Column names each canonical field may arrive under.
FIELD_ALIASES = {
    "serial": ["serial_number", "serial_no", "slno", "srno", "क्रमांक"],
    "id_code": ["epic_number", "epic_no", "epic", "voter_id", "voterid", "पहचानपत्रक्र"],
    "name_auto": ["name", "voter_name", "fullname", "मतदाताकानाम", "निर्वाचककानाम"],
    "name_dev": ["name_hi", "voter_name_hindi", "name_hindi", "नाम_हिंदी"],
    "name_lat": ["name_en", "voter_name_english", "name_english", "name_eng"],
    "relation_type": ["relation_type", "relation", "संबंध", "रिश्ता"],
    "rel_auto": [
        "relation_name",
        "father_name",
        "husband_name",
        "mother_name",
        "पिताकानाम",
        "संबंधीकानाम",
    ],
    "rel_dev": ["relation_name_hi", "father_name_hi"],
    "rel_lat": ["relation_name_en", "father_name_en"],
    "father": ["father_name", "fathername", "पिताकानाम"],
    "husband": ["husband_name", "husbandname", "पतिककानाम"],
    "mother": ["mother_name", "mothername", "माताकानाम"],
    "gender": ["gender", "sex", "लिंग"],
    "age": ["age", "voter_age", "उम्र", "आयु"],
    "house": ["house_number", "house_no", "hno", "मकाननंबर", "गृहसंख्या"],
    "ward": ["ward_number", "ward_no", "ward", "वार्ड"],
    "part": ["part_number", "part_no", "part", "भागसंख्या"],
    "area": ["area", "section_name", "section", "अनुभाग"],
    "constituency": ["assembly_constituency", "assembly", "विधानसभा"],
    "district": ["district", "जिला"],
}
# Fragments of a squashed header that suggest a field. More
# specific fields come first, so "father_name" is a relation and not a name.
HEADER_HINTS = [
    ("id_code", ["epic", "voterid", "पहचान"]),
    ("name_dev", ["namehi", "नामहिंदी"]),
    ("name_lat", ["nameen", "nameeng"]),
    ("relation_type", ["reltype", "relationtype", "रिश्ता"]),
    ("rel_auto", ["father", "पिता", "husband", "mother", "relation", "संबंध"]),
    ("name_auto", ["name", "नाम", "voter"]),
    ("gender", ["gender", "sex", "लिंग"]),
    ("house", ["house", "hno", "मकान", "गृह"]),
    ("ward", ["ward", "वार्ड"]),
    ("part", ["part", "भाग"]),
    ("serial", ["serial", "slno", "क्रमांक"]),
    ("area", ["area", "section", "अनुभाग"]),
]
# Short hints match a whole word of the header ("AGE", "voter_age"), never
# the inside of one ("page", "village").
HEADER_WORD_HINTS = [("age", ["age", "उम्र", "आयु"])]

# --------------------------------------------------------- transliteration
# Latin spellings of single Devanagari signs.
LATIN_CONSONANTS = {
    "k": "क", "kh": "ख", "g": "ग", "gh": "घ",
    "ch": "च", "chh": "छ", "j": "ज", "jh": "झ",
    "t": "त", "th": "थ", "d": "द", "dh": "ध", "n": "न",
    "p": "प", "ph": "फ", "f": "फ", "b": "ब", "bh": "भ", "m": "म",
    "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व",
    "sh": "श", "shh": "ष", "s": "स", "h": "ह",
    "ks": "क्ष", "ksh": "क्ष", "gy": "ज्ञ",
    "tr": "त्र", "cr": "क्र", "kr": "क्र", "pr": "प्र", "br": "ब्र", "gr": "ग्र", "dr": "द्र",
}
LATIN_VOWEL_SIGNS = {
    "a": "ा", "aa": "ा", "i": "ि", "ee": "ी", "u": "ु", "oo": "ू",
    "e": "े", "ai": "ै", "o": "ो", "au": "ौ", "ou": "ौ",
}
LATIN_INITIAL_VOWELS = {
    "a": "अ", "aa": "आ", "i": "इ", "ee": "ई", "u": "उ", "oo": "ऊ",
    "e": "ए", "ai": "ऐ", "o": "ओ", "au": "औ", "ou": "औ",
}
# Devanagari signs and their Latin spelling.
DEVANAGARI_VOWELS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo",
    "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri",
    "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ं": "n", "ँ": "n",
}
DEVANAGARI_CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
HALANT = "्"
LONG_A_SIGN = "ा"
# Common names with one agreed spelling in each script.
COMMON_NAMES = {
    "ram": "राम",
    "shyam": "श्याम",
    "dayal": "दयाल",
    "ramdayal": "रामदयाल",
    "ramesh": "रमेश",
    "suresh": "सुरेश",
    "rajesh": "राजेश",
    "dinesh": "दिनेश",
    "mahesh": "महेश",
    "mukesh": "मुकेश",
    "sunita": "सुनीता",
    "anita": "अनीता",
    "geeta": "गीता",
    "seema": "सीमा",
    "pooja": "पूजा",
    "vikram": "विक्रम",
    "vikas": "विकास",
    "rahul": "राहुल",
    "amit": "अमित",
    "sumit": "सुमित",
    "ajay": "अजय",
    "vijay": "विजय",
    "sanjay": "संजय",
    "sharma": "शर्मा",
    "verma": "वर्मा",
    "gupta": "गुप्ता",
    "singh": "सिंह",
    "yadav": "यादव",
    "kumar": "कुमार",
    "kumari": "कुमारी",
    "devi": "देवी",
    "prasad": "प्रसाद",
    "choudhary": "चौधरी",
    "chaudhary": "चौधरी",
    "mishra": "मिश्रा",
    "jha": "झा",
    "lakshmi": "लक्ष्मी",
    "laxmi": "लक्ष्मी",
}
# Name endings that are also written as a separate word.
DEVANAGARI_NAME_ENDINGS = [
    "कुमार", "सिंह", "शर्मा", "वर्मा", "प्रसाद", "लाल", "दयाल", "देवी", "गुप्ता", "यादव",
]
LATIN_NAME_ENDINGS = [
    "dayal", "kumar", "singh", "sharma", "verma", "prasad", "lal", "devi", "gupta", "yadav",
    "prakash",
]

# --------------------------------------------------------------- redaction
# Key names whose values are secrets, and what replaces them.
SECRET_KEYS = (
    "password|token|secret|authorization|cookie|credential|api[_-]?key|private"
)
REDACTED = "[REDACTED_SECRET]"

# ------------------------------------------------------------ file signature
# Leading bytes (hex), media types and messages per file kind.
MAX_FILE_BYTES = 50 * 1024 * 1024
PDF_MAGIC_HEX = "255044462D"
ZIP_MAGIC_HEX = "504B0304"
MIME_PDF = "application/pdf"
MIME_XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
MIME_CSV = "text/csv"
MIME_BYTES = "application/octet-stream"

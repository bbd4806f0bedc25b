"""Words of printed register pages.

Each list holds the spellings of one thing. Some labels also occur in the
garbled form that an old font encoding leaves in extracted text; those
spellings stand beside the right ones. Blanks inside a label may be missing.
"""

# ------------------------------------------------------------ page header
HEADER_LABELS = {
    "constituency": [
        "विधानसभा क्षेत्र", "विधानसभा निर्वाचन क्षेत्र", "विधानसभा क्षेत्र की संख्या एवं नाम",
        "विधानसभा निर्वाचन क्षेत्र की संख्या एवं नाम", "विधान सभा", "Assembly Constituency",
    ],
    "ward": ["वार्ड संख्या", "Ward No"],
    "part": ["भाग संख्या", "भाग नं", "Part No"],
    "area": ["अनुभाग संख्या व नाम", "अनुभाग संख्या", "अनुभाग का नाम", "Section"],
    "municipality": ["नगरनिगम / नगरपरिषद / नगरपालिका का नाम", "नगरनिगम", "नगरपरिषद", "नगरपालिका"],
    "polling_place": ["मतदान केंद्र की संख्या एवं पता", "मतदान स्थल", "मतदान केन्द्र", "Polling Station"],
    # Words that only end the value before them.
    "stop": ["वार्ड", "भाग", "अनुभाग", "मतदान", "मतदाताओं", "आरम्भिक", "Part", "Polling"],
}
HEADER_FIELDS = [field for field in HEADER_LABELS if field != "stop"]
NUMBER_FIELDS = ["ward", "part"]

# Pages 1 and 2 hold cards only when one of these occurs.
BOX_MARKS = ["Photo is", "निर्वाचक का नाम", "मकान संख्या"]

# ---------------------------------------------------------------- section
SECTION_WORDS = ["बस्ती", "नगर", "वाटिका", "अपार्टमेंट", "कॉलोनी", "सड़क", "मोहल्ला"]
NOT_A_SECTION = ["निर्वाचन", "विधानसभा"]
MIN_SECTION_CHARS = 5

# ------------------------------------------------------------------- card
RELATIONS = ["FATHER", "HUSBAND", "MOTHER", "OTHER"]
CARD_LABELS = {
    "name": ["नाम", "नपम", "निर्वाचक का नाम", "मतदाता का नाम"],
    "FATHER": ["पिता का नाम", "नपतप कप नपम", "Father's Name", "Fathers Name", "Father Name"],
    "HUSBAND": ["पति का नाम", "पनत कप नपम", "Husband's Name", "Husbands Name", "Husband Name"],
    "MOTHER": ["माता का नाम", "मपतप कप नपम", "Mother's Name", "Mothers Name", "Mother Name"],
    "OTHER": ["अन्य संबंधी", "संबंधी का नाम", "अन्य का नाम", "अनय कप नपम", "Other"],
    "house": ["मकान संख्या", "मकपन सनखयप", "मकान नं", "गृह संख्या", "House No"],
    "age": ["आयु", "आयप", "उम्र", "Age"],
    "gender": ["लिंग"],
    # Words that end the value before them; after a house label, the house words do not.
    "house_word": ["मकान", "गृह"],
    "stop": ["पिता", "पति", "माता", "अन्य", "संबंधी", "निर्वाचक", "मतदाता", "Photo is", "Photo", "Available"],
}
# With a colon behind them: labels that start a card, show that a card holds data, and mark a block as a card.
# The plain name label does all three, but only at the start of a line.
PLAIN_NAME = "नाम"
CHUNK_HEADS = ["नाम", "नपम"]
NAME_HEADS = ["नाम", "निर्वाचक का नाम", "मतदाता का नाम"]
DATA_LABELS = ["निर्वाचक", "मतदाता", "पिता", "पति", "माता", "अन्य", "उम्र", "आयु"]
BLOCK_LABELS = ["निर्वाचक का नाम", "मतदाता का नाम", "पिता का नाम", "पति का नाम", "माता का नाम", "उम्र", "आयु"]
NOT_A_NAME_LINE = "अनुभाग"
MIN_CARD_CHARS = 15

# Shapes of official id codes.
ID_CODE_SHAPES = ["[A-Z]{2,4}/[0-9/]{3,12}", "[A-Z]{3}[0-9]{7}", "[A-Z]{2,3}[0-9]{6,8}", "[A-Z0-9]{3}[0-9]{7}"]

# Words for the two codes; the one-letter Devanagari ones count only behind the gender label,
# as the second also abbreviates a house label.
MALE_WORDS = ["पुरुष", "पपरष", "male", "m"]
FEMALE_WORDS = ["स्त्री", "सर", "महिला", "female", "f"]
MALE_LETTER = "पु"
FEMALE_LETTER = "म"
DELETED_WORD = "deleted"
DELETED_LETTER = "O"

# Names that are page furniture, not people.
NOT_A_NAME = "लिंग"
NOT_IN_A_NAME = ["निर्वाचन", "विधानसभा", "नगरपालिका"]

# Review reasons and confidences.
NO_ID_CODE = "Missing official id code"
NO_AGE = "Missing age"
AGE_RANGE = "is outside the accepted range (18-130)"
MARKED_DELETED = "Marked DELETED in supplementary list"
CONFIDENCE_WITH_CODE = 0.98
CONFIDENCE_WITHOUT_CODE = 0.85

"""Word lists, tables and patterns whose contents are part of the results."""

# Fixed values. Devanagari letters in Latin script.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
    "क़": "q", "ख़": "kh", "ग़": "gh", "ज़": "z", "ड़": "d", "ढ़": "dh", "फ़": "f", "य़": "y",
}
VOWELS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri",
    "ऎ": "e", "ए": "e", "ऐ": "ai", "ऑ": "o", "ऒ": "o", "ओ": "o", "औ": "au",
}
VOWEL_SIGNS = {
    "ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "ॅ": "e",
    "ॆ": "e", "े": "e", "ै": "ai", "ॉ": "o", "ॊ": "o", "ो": "o", "ौ": "au",
}
#: Candrabindu, anusvara, visarga; nukta and virama have no sound.
OTHER_SIGNS = {"ँ": "n", "ं": "n", "ः": "h", "़": "", "्": ""}
DEVANAGARI_WORDS = {
    "प्राइवेट": "private", "लिमिटेड": "limited", "प्रा.": "pvt", "प्रा": "pvt", "लि.": "ltd", "लि": "ltd",
    "एलएलपी": "llp", "कंपनी": "company", "कॉर्पोरेशन": "corporation", "एंटरप्राइजेज": "enterprises",
    "इंडस्ट्रीज": "industries", "सॉल्यूशंस": "solutions", "सर्विसेज": "services", "मार्केटिंग": "marketing",
    "ट्रेडर्स": "traders", "प्रॉपर्टीज": "properties", "कंस्ट्रक्शंस": "constructions", "टेक्नोलॉजीज": "technologies",
    "इन्वेस्टमेंट": "investment", "वेंचर्स": "ventures", "डेवलपर्स": "developers", "इंटरनेशनल": "international",
    "इंडिया": "india", "भारत": "bharat", "महाराष्ट्र": "maharashtra", "दिल्ली": "delhi", "कर्नाटक": "karnataka",
    "गुजरात": "gujarat", "राजस्थान": "rajasthan", "हरियाणा": "haryana", "पंजाब": "punjab", "बंगाल": "bengal",
}
KANNADA_WORDS = {"ಕರ್ನಾಟಕ": "karnataka", "ಬೆಂಗಳೂರು": "bangalore", "ಮಹಾರಾಷ್ಟ್ರ": "maharashtra"}
#: The plainer letter table: long vowels doubled, no inherent vowel.
PLAIN_SIGNS = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ii", "उ": "u", "ऊ": "uu", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri",
    "ा": "aa", "ि": "i", "ी": "ii", "ु": "u", "ू": "uu", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "ं": "n", "ः": "h", "्": "", "ृ": "ri", "़": "", "ँ": "n", "ॉ": "o",
}
#: Consonants that the plainer table has too.
PLAIN_CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"

# Fixed values. States of the US and their codes.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA",
    "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD",
    "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}

# Fixed values. Legal forms: at the start of a name, at its end, anywhere; as single tokens.
LEADING_FORMS = "pvt ltd|private limited|llc|llp|inc|corp|ltd|co|sarl|sas|sci|sa"
TRAILING_FORMS = "pvt ltd|private limited|llc|llp|inc|incorporated|corp|corporation|ltd|limited|co|company|sarl|sas|sci|sa|eurl|snc|gmbh"
ANY_FORMS = (
    "private limited|pvt ltd|pvt|ltd|limited|llc|pllc|llp|inc|incorporated|corp|corporation|co|company|"
    "sarl|sas|sci|sa|eurl|snc|gmbh|public limited|pub ltd|plc"
)
FORM_TOKENS = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "plc", "pvt", "private",
    "gmbh", "ag", "sa", "sarl", "srl", "bv", "nv", "dba", "pte", "pty", "group", "holdings", "enterprises", "ventures",
]

# Fixed values. Patterns of names and addresses.
DBA = r"\b(d/?b/?a|doing business as|trading as|t/?a)\b"
DBA_AKA = r"\b(d/?b/?a|doing business as|trading as|t/?a|aka)\b"
REDACTED = r"(^[#*X]{2,}\d*|\b[#*X]{2,}\d*\b)"
LANDMARK = r"\b(near|opp|opposite|behind|beside|adjacent to|next to|above|below)\b"
LABELLED_NUMBER = r"\b(?:door\s*no\.?|h\.?\s*no\.?|plot\s*no\.?|kh\s*no\.?|unit\s*no\.?|no\.)\s*([0-9]+[a-zA-Z0-9/\-]*)\b"

# Fixed values. Street words by abbreviation.
STREETS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "ct": "court",
    "dr": "drive", "ln": "lane", "hwy": "highway", "pkwy": "parkway", "apartment": "apt", "ste": "suite",
}
#: Of the token-wise variant.
STREET_TOKENS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "cir": "circle", "pkwy": "parkway", "hwy": "highway", "trl": "trail", "sq": "square", "ter": "terrace",
    "xing": "crossing", "nr": "near", "opp": "opposite", "flr": "floor", "apt": "apartment",
}

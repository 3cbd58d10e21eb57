"""Word lists, tables and patterns that results depend on. They are data, kept together and in plain order."""

# Tokens that name a legal form.
LEGAL = frozenset(["inc", "incorporated", "llc", "corp", "corporation", "co", "ltd", "limited", "gmbh", "ag", "kg", "sarl", "sa", "sas", "pvt", "private", "ltda", "me", "kk", "plc", "llp", "bv", "nv", "srl", "spa", "oy", "ab", "as", "pte", "pty", "sl", "lp", "company"])
# Words that names are compared without.
STOP = frozenset(["the", "and", "of", "de", "la", "le", "les", "das", "der", "die", "du", "des", "da", "do", "et"])
# The same where legal forms come from the country tables.
STOP_WITH_TABLES = frozenset(["the", "and", "of", "de", "la", "le", "les", "du", "des", "et", "l", "d"])
# Abbreviations in names.
ABBREVIATIONS = {
    "intl": "international", "int'l": "international", "svcs": "services", "svc": "services", "hldgs": "holdings", "hldg": "holdings",
    "ent": "enterprises", "eng": "engineering", "elec": "electronics", "constr": "construction", "bros": "brothers", "mfg": "manufacturing",
    "grp": "group", "tech": "technology", "natl": "national", "assoc": "associates",
}
# Legal forms by country, each with its class; _generic serves countries without a table.
LEGAL_FORMS = {
    "US": {
        "inc": "INC", "incorporated": "INC", "llc": "LLC", "l l c": "LLC", "corp": "CORP", "corporation": "CORP", "co": "CO", "company": "CO",
        "lp": "LP", "llp": "LLP", "lllp": "LLP", "ltd": "LTD", "limited": "LTD", "pllc": "PLLC", "pc": "PC", "pa": "PA",
    },
    "IN": {
        "pvt ltd": "PVT_LTD", "private limited": "PVT_LTD", "pvt limited": "PVT_LTD", "private ltd": "PVT_LTD", "p ltd": "PVT_LTD", "ltd": "LTD",
        "limited": "LTD", "llp": "LLP", "and co": "AND_CO", "and company": "AND_CO", "co": "CO", "company": "CO", "proprietorship": "PROP",
        "opc": "OPC", "opc pvt ltd": "OPC", "opc private limited": "OPC",
    },
    "FR": {
        "sarl": "SARL", "sas": "SAS", "sasu": "SASU", "eurl": "EURL", "sa": "SA", "eirl": "EIRL", "snc": "SNC", "sci": "SCI", "selarl": "SELARL", "scop": "SCOP",
    },
    "_generic": {
        "inc": "INC", "incorporated": "INC", "llc": "LLC", "llp": "LLP", "corp": "CORP", "corporation": "CORP", "company": "CO", "ltd": "LTD",
        "limited": "LTD", "plc": "PLC", "pvt ltd": "PVT_LTD", "private limited": "PVT_LTD", "gmbh": "GMBH", "sarl": "SARL", "sasu": "SASU", "eurl": "EURL",
    },
}
# What countries are called.
COUNTRIES = {
    "us": "US", "usa": "US", "united states": "US", "united states of america": "US", "de": "DE", "germany": "DE", "deutschland": "DE",
    "fr": "FR", "france": "FR", "in": "IN", "india": "IN", "br": "BR", "brazil": "BR", "brasil": "BR", "jp": "JP", "japan": "JP",
    "gb": "GB", "uk": "GB", "united kingdom": "GB", "es": "ES", "spain": "ES", "espana": "ES", "it": "IT", "italy": "IT", "italia": "IT",
    "ca": "CA", "canada": "CA", "mx": "MX", "mexico": "MX", "cn": "CN", "china": "CN", "au": "AU", "australia": "AU", "nl": "NL", "netherlands": "NL",
}
# Kinds of streets and how they are written; the second table is added where addresses are read by content.
STREETS = {
    "st": "street", "street": "street", "str": "strasse", "strasse": "strasse", "ave": "avenue", "av": "avenue", "avenue": "avenue", "avenida": "avenida",
    "rd": "road", "road": "road", "blvd": "boulevard", "bd": "boulevard", "boulevard": "boulevard", "rue": "rue", "rua": "rua", "r": "r", "weg": "weg",
    "allee": "allee", "marg": "marg", "ngr": "nagar", "nagar": "nagar", "tv": "travessa", "travessa": "travessa", "dori": "dori", "machi": "machi",
    "ln": "lane", "lane": "lane", "dr": "drive", "drive": "drive", "way": "way", "pl": "place", "place": "place",
}
MORE_STREETS = {
    "chemin": "chemin", "ch": "chemin", "chem": "chemin", "impasse": "impasse", "imp": "impasse", "quai": "quai", "cours": "cours", "crs": "cours",
    "square": "square", "sq": "square", "route": "route", "rte": "route", "faubourg": "faubourg", "fbg": "faubourg", "salai": "salai", "gali": "gali",
}
# Words that streets are compared without.
STREET_STOP = frozenset(["de", "du", "des", "la", "le", "les", "l", "d", "del", "della", "von", "van", "der", "the", "of", "bis", "ter", "quater", "no", "plot", "door", "h", "shop", "flat"])
# Words before a unit.
UNITS = frozenset(["suite", "ste", "unit", "apt", "floor", "fl", "room", "rm"])
# Patterns of address parts.
POSTAL_TOKEN = r"^(?:[a-z]?\d{5}-\d{3}|\d{3}-\d{4}|\d{5,6}|\d{4})$"
LANDMARK = r"^\s*(near|nr|opp|opposite|behind|beside|next to|adjacent to|above|below|in front of|landmark|close to)\b"
UNIT_PART = r"^\s*(suite|ste|unit|apt|apartment|fl|floor|room|rm|#|shop|office|flat)\s*\.?\s*[\w-]{1,4}\s*$"
DOOR = r"(?i)^\s*(?:#|no\.?|door no\.?|plot(?: no\.?)?|h\.?\s?no\.?)?\s*[\dA-Za-z]*\d[\dA-Za-z/-]*\s*$"
REGION_POSTAL = r"(?i)^\s*[a-z]{2,3}\s*-?\s*\d{3}\s?\d{2,3}(?:-\d{3,4})?\s*$"
POSTAL_BY_COUNTRY = {
    "US": [r"(?<![\d-])(\d{5})(?:-\d{4})?(?!\d)"],
    "IN": [r"(?<!\d)([1-9]\d{2})\s?(\d{3})(?!\d)"],
    "FR": [r"(?<!\d)(\d{5})(?!\d)"],
}
POSTAL_ANYWHERE = [r"(?<!\d)(\d{5})-(\d{3})(?!\d)", r"(?<!\d)(\d{3})-(\d{4})(?!\d)", r"(?<![\d-])(\d{5})(?:-\d{4})?(?!\d)", r"(?<!\d)([1-9]\d{2})\s?(\d{3})(?!\d)"]
# Dotted initials, and what stands before an Indian firm.
INITIALS = r"(?<![A-Za-z])(?:[A-Za-z]\.\s*)+[A-Za-z]\.?(?![A-Za-z])"
HONORIFIC = r"^\s*(?:m\s*/\s*s\.?|messrs\.?)\s+"

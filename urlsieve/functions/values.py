"""Word lists, character maps and counts that results depend on. Don't edit, reorder or extend."""

# Words of login and verification pages.
KEYWORDS = (
    "login", "signin", "verify", "secure", "account", "update", "confirm",
    "banking", "webscr", "ebayisapi", "password", "billing", "suspend",
)

# Official domains of brands that are often impersonated.
OFFICIAL_DOMAINS = (
    "microsoft.com", "live.com", "outlook.com", "office.com", "office365.com", "microsoftonline.com",
    "google.com", "gmail.com", "youtube.com",
    "apple.com", "icloud.com",
    "facebook.com", "fb.com", "messenger.com", "instagram.com", "whatsapp.com", "meta.com",
    "amazon.com", "netflix.com", "linkedin.com", "yahoo.com", "adobe.com", "dropbox.com", "docusign.com", "docusign.net",
    "github.com", "twitter.com", "x.com", "tiktok.com", "discord.com", "telegram.org", "zoom.us", "spotify.com", "roblox.com",
    "steampowered.com", "steamcommunity.com",
    "ebay.com", "walmart.com", "alibaba.com", "aliexpress.com", "costco.com", "target.com", "bestbuy.com", "booking.com", "airbnb.com",
    "paypal.com", "chase.com", "wellsfargo.com", "bankofamerica.com", "citi.com", "hsbc.com", "americanexpress.com", "mastercard.com",
    "visa.com", "binance.com", "coinbase.com",
    "dhl.com", "fedex.com", "ups.com", "usps.com", "att.com", "verizon.com", "xfinity.com", "irs.gov",
)

# Curated brand labels.
CURATED_BRANDS = (
    "paypal", "stripe", "venmo", "square", "cashapp", "zelle", "wise",
    "revolut", "westernunion", "moneygram", "skrill", "payoneer", "klarna",
    "affirm", "afterpay",
    "chase", "wellsfargo", "bankofamerica", "boa", "citibank", "citi",
    "hsbc", "barclays", "lloydsbank", "natwest", "santander", "usbank",
    "capitalone", "pnc", "tdbank", "regions", "truist", "ally",
    "americanexpress", "amex", "discover", "goldmansachs", "morganstanley",
    "commonwealthbank", "nab", "anz", "westpac",
    "coinbase", "binance", "kraken", "blockchain", "metamask", "gemini",
    "bitfinex", "kucoin", "crypto",
    "google", "microsoft", "apple", "amazon", "facebook", "meta",
    "instagram", "whatsapp", "twitter", "linkedin", "netflix", "youtube",
    "yahoo", "outlook", "office365", "icloud", "dropbox", "adobe",
    "spotify", "zoom", "slack", "github", "gitlab", "salesforce", "oracle",
    "ibm", "intuit", "quickbooks", "turbotax",
    "fedex", "ups", "dhl", "usps", "auspost", "royalmail",
    "ebay", "etsy", "walmart", "target", "bestbuy", "alibaba", "aliexpress",
    "shopify",
    "att", "verizon", "tmobile", "sprint", "comcast", "xfinity", "vodafone",
    "telstra", "optus",
    "irs", "ssa", "medicare", "ato", "hmrc",
    "steam", "playstation", "xbox", "nintendo", "disneyplus", "hulu",
    "uber", "lyft", "airbnb", "booking", "expedia", "delta", "united",
    "americanairlines",
    "docusign", "wetransfer", "dhlparcel",
)

# The sign that stands for an official brand's label.
BRAND_MASK = "§"

# Look-alikes of Latin letters, and further ones that folding maps.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ɡ": "g",
    "ⅰ": "i", "ⅼ": "l", "０": "0", "１": "1",
    "α": "a", "ο": "o", "υ": "y", "ν": "v", "κ": "k",
}
CONFUSABLES = HOMOGLYPHS | {
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "ι": "i", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
    "ı": "i", "ɩ": "i", "ɑ": "a",
}
LEETSPEAK = {"0": "o", "1": "l", "3": "e", "5": "s", "7": "t", "4": "a"}

# The characters that attacks put in.
CYRILLIC = {"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "i": "і", "j": "ј", "s": "ѕ", "h": "һ", "d": "ԁ"}
GREEK = {"a": "α", "o": "ο", "v": "ν", "k": "κ", "i": "ι", "p": "ρ"}
DOTTED = {
    "a": "ạ", "b": "ḅ", "d": "ḍ", "e": "ẹ", "h": "ḥ", "i": "ị", "k": "ḳ", "l": "ḷ",
    "m": "ṃ", "n": "ṇ", "o": "ọ", "r": "ṛ", "s": "ṣ", "t": "ṭ", "u": "ụ", "v": "ṿ",
    "w": "ẉ", "y": "ỵ", "z": "ẓ", "c": "ċ", "f": "ḟ", "g": "ġ", "p": "ṗ", "x": "ẋ",
}

# Counts that rule explanations quote.
RULE_STATS = {
    "ip_host": (19168, 0.9986), "punycode_host": (3765, 0.9963), "long_url": (35932, 0.7893), "brand_lookalike": (64, 0.9844),
}
LONG_URL, LONG_URL_QUANTILE, LOOKALIKE_LENGTH = 136, 0.99, 5
RISKY_SUFFIXES = {
    "app": (9519, 0.9631), "asia": (2038, 0.9637), "buzz": (1109, 0.9991), "cf": (6353, 0.9906), "cfd": (2198, 1.0),
    "ci": (2040, 0.9946), "click": (1139, 0.9956), "cloud": (1193, 0.9681), "club": (4651, 0.9873), "cn": (35238, 0.9929),
    "dev": (6856, 0.9717), "fun": (1046, 0.9924), "gq": (4102, 0.9966), "icu": (5013, 0.9996), "link": (2980, 0.9815),
    "live": (1406, 0.963), "ly": (2904, 0.9697), "ml": (8716, 0.9985), "network": (1775, 0.9544), "online": (7212, 0.9927),
    "page": (1319, 0.9955), "pw": (2221, 0.9892), "shop": (6900, 0.9971), "site": (6856, 0.9956), "su": (1158, 0.9577),
    "tk": (12624, 0.9932), "top": (34581, 0.9996), "vip": (1029, 0.9903), "vu": (1792, 0.9955), "website": (1125, 0.9893),
    "xyz": (19031, 0.9922),
}

# Limits of a URL and of its client.
MAX_URL_LENGTH = 2048
BUCKET_REQUESTS, BUCKET_SECONDS = 30, 60.0

#: Registries that take names under these second-level labels only, for use without a file; a full list's path can be given instead.
SECOND_LEVEL = {
    "ac.be ac.id ac.il ac.in ac.jp ac.ke ac.kr ac.nz ac.th ac.uk ac.za": "", "ae": "co net org gov ac sch", "ar": "com edu gob gov int mil net org tur", "au": "com net org edu gov asn id", "bd": "com net org edu gov",
    "br": "com net org gov edu mil art blog eco ind inf jus leg adv eng med", "cn": "com net org gov edu mil ac", "co": "com net org edu gov mil nom", "cy": "com net org gov ac", "eg": "com net org edu gov",
    "gr": "com net org edu gov", "hk": "com net org edu gov idv", "id": "co net or go sch mil web my", "il": "co net org gov muni", "in": "co net org gov edu firm gen ind nic res", "jp": "co ne or go ad ed gr lg",
    "ke": "co ne or go sc", "kr": "co ne or go pe re", "mx": "com net org edu gob", "my": "com net org edu gov mil name", "ng": "com net org edu gov", "nz": "co net org govt school gen geek iwi kiwi maori",
    "pe": "com net org edu gob mil nom", "ph": "com net org edu gov mil", "pk": "com net org edu gov", "pl": "com net org edu gov info", "pt": "com org edu gov", "ru": "", "sa": "com net org edu gov med sch",
    "sg": "com net org edu gov per", "th": "co net or go in mi", "tr": "com net org edu gov bel pol k12 gen web av dr", "tw": "com net org edu gov mil idv", "ua": "com net org edu gov in",
    "uk": "co net org gov ltd me nhs plc police sch", "uy": "com net org edu gub mil", "ve": "co com net org edu gob", "vn": "com net org edu gov ac", "za": "co net org gov edu law web",
}
SUFFIX_RULES = (
    "com", "net", "org", "info", "biz", "edu", "gov", "mil", "int", "io", "co", "me", "tv", "us", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk",
    "de", "fr", "es", "it", "nl", "eu", "ru", "pl", "ch", "at", "be", "se", "jp", "co.jp", "ne.jp", "au", "com.au", "br", "com.br", "in", "co.in",
    "ck", "*.ck", "!www.ck", "support", "cc", *RISKY_SUFFIXES,
    "cz", "dk", "fi", "hu", "ie", "il", "is", "lt", "lu", "lv", "no", "nu", "ro", "rs", "si", "sk", "tw", "ca", "mobi", "name", "pro", "aero", "coop", "museum", "jobs", "travel", "tel", "cat", "blog", "store", "tech", "space",
    *[r for names, below in SECOND_LEVEL.items() for name in names.split() for r in (name, *[f"{b}.{name}" for b in below.split()])],
)
SUFFIX_RULES = tuple(dict.fromkeys(SUFFIX_RULES))

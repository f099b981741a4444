"""Fixed values that results depend on: word lists, look-up tables, patterns and weights."""

# Words removed from names before matching, in this order and anywhere in the name.
NAME_SUFFIXES = ["pvt ltd", "pvt. ltd.", "private limited", "ltd", "limited", "llp", "llc", "inc", "incorp", "corp", "corporation", "co", "company", "enterprises", "enterprise", "and sons", "& sons"]

# Cities that may trail a name after a comma, tried in this order.
TRAILING_CITIES = ["eluru", "bangalore", "bengaluru", "hyderabad", "chennai", "mumbai", "delhi", "vijayawada", "visakhapatnam", "guntur", "tirupati", "warangal", "nellore", "kurnool", "rajamahendravaram", "kakinada", "bhimavaram", "narsapur", "tadepalligudem"]

STATES = ["Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi"]

STATE_CODES = {
    "AP": "Andhra Pradesh", "AR": "Arunachal Pradesh", "AS": "Assam", "BR": "Bihar", "CG": "Chhattisgarh", "GA": "Goa", "GJ": "Gujarat", "HR": "Haryana", "HP": "Himachal Pradesh", "JH": "Jharkhand",
    "KA": "Karnataka", "KL": "Kerala", "MP": "Madhya Pradesh", "MH": "Maharashtra", "MN": "Manipur", "ML": "Meghalaya", "MZ": "Mizoram", "NL": "Nagaland", "OD": "Odisha", "OR": "Odisha",
    "PB": "Punjab", "RJ": "Rajasthan", "SK": "Sikkim", "TN": "Tamil Nadu", "TS": "Telangana", "TR": "Tripura", "UP": "Uttar Pradesh", "UK": "Uttarakhand", "WB": "West Bengal", "DL": "Delhi",
}

CITY_ALIASES = {"bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai", "calcutta": "Kolkata", "madras": "Chennai", "trivandrum": "Thiruvananthapuram", "cochin": "Kochi", "poona": "Pune"}

# Whole words of an address, case-sensitive, in this order.
ADDRESS_WORDS = {"St": "Street", "Rd": "Road", "Ave": "Avenue", "Blvd": "Boulevard", "Dr": "Drive", "Ln": "Lane", "Ct": "Court", "Pl": "Place", "Hr": "Harbour"}

# Hundredths of the completeness of a raw record.
COMPLETENESS = {"name": 25, "phone": 20, "address": 15, "website": 15, "city": 10, "position": 10, "rating": 5}

# Phone prefixes after India's, in this order.
PHONE_COUNTRIES = {
    "+44": "United Kingdom", "+1": "United States", "+61": "Australia", "+81": "Japan", "+49": "Germany", "+33": "France", "+55": "Brazil", "+52": "Mexico",
    "+86": "China", "+971": "UAE", "+65": "Singapore", "+82": "South Korea", "+39": "Italy", "+34": "Spain", "+31": "Netherlands", "+46": "Sweden",
}
COUNTRY_CITIES = {
    "United Kingdom": ["london", "manchester", "birmingham", "leeds", "glasgow", "edinburgh", "liverpool", "bristol", "cardiff", "belfast"],
    "United States": ["new york", "los angeles", "chicago", "houston", "phoenix", "san francisco", "seattle", "boston", "miami", "dallas"],
    "Canada": ["toronto", "vancouver", "montreal", "calgary", "ottawa"],
}

CITY_POSITIONS = {
    "eluru": (16.7104, 81.1154), "bangalore": (12.9716, 77.5946), "bengaluru": (12.9716, 77.5946), "hyderabad": (17.3850, 78.4867), "chennai": (13.0827, 80.2707), "mumbai": (19.0760, 72.8777),
    "pune": (18.5204, 73.8567), "delhi": (28.6139, 77.2090), "vijayawada": (16.5062, 80.6480), "visakhapatnam": (17.6868, 83.2185), "vizag": (17.6868, 83.2185), "guntur": (16.3067, 80.4365),
    "tirupati": (13.6288, 79.4192), "warangal": (17.9784, 79.5941), "nellore": (14.4426, 79.9865), "kurnool": (15.8281, 78.0373), "rajamahendravaram": (17.0005, 81.8040), "rajahmundry": (17.0005, 81.8040),
    "kakinada": (16.9891, 82.2475), "bhimavaram": (16.5449, 81.5212), "narsapur": (16.4360, 81.6690), "tadepalligudem": (16.8147, 81.5272), "london": (51.5074, -0.1278), "toronto": (43.6532, -79.3832),
    "new york": (40.7128, -74.0060), "los angeles": (34.0522, -118.2437), "chicago": (41.8781, -87.6298), "san francisco": (37.7749, -122.4194), "seattle": (47.6062, -122.3321), "boston": (42.3601, -71.0589),
    "miami": (25.7617, -80.1918), "dallas": (32.7767, -96.7970), "houston": (29.7604, -95.3698), "paris": (48.8566, 2.3522), "berlin": (52.5200, 13.4050), "tokyo": (35.6762, 139.6503),
    "sydney": (-33.8688, 151.2093), "melbourne": (-37.8136, 144.9631), "singapore": (1.3521, 103.8198), "dubai": (25.2048, 55.2708), "mexico city": (19.4326, -99.1332), "mexico": (19.4326, -99.1332),
    "sao paulo": (-23.5505, -46.6333), "cairo": (30.0444, 31.2357), "lagos": (6.5244, 3.3792), "nairobi": (-1.2921, 36.8219), "cape town": (-33.9249, 18.4241), "bangkok": (13.7563, 100.5018),
    "hong kong": (22.3193, 114.1694), "shanghai": (31.2304, 121.4737), "beijing": (39.9042, 116.4074), "kolkata": (22.5726, 88.3639), "ahmedabad": (23.0225, 72.5714), "jaipur": (26.9124, 75.7873),
    "lucknow": (26.8467, 80.9462), "kochi": (9.9312, 76.2673), "bhopal": (23.2599, 77.4126), "nagpur": (21.1458, 79.0882), "patna": (25.6093, 85.1376), "indore": (22.7196, 75.8577),
    "coimbatore": (11.0168, 76.9558), "madurai": (9.9252, 78.1198), "thiruvananthapuram": (8.5241, 76.9366), "varanasi": (25.3176, 82.9739), "agra": (27.1767, 78.0081), "kanpur": (26.4499, 80.3319),
    "nashik": (19.9975, 73.7898), "johannesburg": (-26.2041, 28.0473), "durban": (-29.8587, 31.0218),
}
LOCATION_RADIUS_DEGREES = 0.45
ENTITY_RADIUS_DEGREES = 0.0005

# Endings of compact names, of which the first that fits is cut off.
BUSINESS_ENDINGS = [
    "hospital", "medical", "center", "centre", "clinic", "labs", "diagnostic", "healthcare", "nursing", "care", "pharmacy", "solutions", "consulting", "technologies", "services", "enterprises",
    "industries", "traders", "suppliers", "dealers", "distributors", "restaurants", "hotels", "resorts", "stores", "shops", "malls", "academy", "institute", "school", "college", "university",
]

# Names of search results that are no businesses.
SKIP_PREFIXES = ["list of ", "top ", "best ", "directory of ", "find ", "all ", "explore "]
SKIP_PHRASES = [
    "empanelled", "facilities in india", "across india", "interactive map", "contact details and", "world health organization", "who.int", "government", "ministry", "cghs", "ayushman", "articles",
    "guides", "tips", "reviews of", "vs ", "comparison", "how to", "what is", "benefits of", "cost of", "price of", "near me", "list of", "top 10", "best 10",
]
SKIP_WORDS = ["wikipedia", "youtube", "facebook", "twitter", "quora", "reddit", "linkedin", "instagram", "news", "article", "blog", "list of", "best", "top", "who.int", "government", "ministry", "directory"]

# Category words that say nothing about the trade.
GENERIC_CATEGORY_WORDS = [
    "the", "and", "for", "with", "near", "around", "from", "that", "this", "shop", "shops", "store", "stores", "center", "centre", "company", "companies", "business", "services", "service", "solutions",
    "enterprises", "industries", "traders", "dealers", "distributors", "suppliers", "agency", "agencies", "group", "associates", "partners", "rental", "rentals", "hire", "hiring", "provider",
    "providers", "consulting", "consultants", "management",
]
# Industries that rule a record out of a category.
INDUSTRY_CONFLICTS = {
    "clothing shops": ["food", "restaurant", "bakery", "cafe", "hospitality", "hotel", "healthcare", "automotive", "technology", "finance", "blog", "entertainment"],
    "hospitals": ["food", "restaurant", "retail", "clothing", "fashion", "hospitality", "hotel", "entertainment", "technology", "automotive", "finance", "blog"],
    "pharmacies": ["food", "restaurant", "retail", "clothing", "fashion", "hospitality", "hotel", "entertainment", "automotive", "technology", "blog", "finance"],
    "hotels": ["food", "restaurant", "retail", "clothing", "fashion", "healthcare", "pharmaceutical", "blog", "technology"],
    "solar companies": ["food", "restaurant", "retail", "clothing", "fashion", "hospitality", "healthcare", "blog", "technology"],
    "bakeries": ["retail", "clothing", "fashion", "healthcare", "hospitality", "automotive", "technology", "restaurant", "blog"],
    "spa": ["food", "restaurant", "retail", "clothing", "fashion", "hospitality", "hotel", "healthcare", "automotive", "technology", "blog"],
    "parks": ["food", "restaurant", "retail", "clothing", "fashion", "hospitality", "hotel", "healthcare", "automotive", "technology", "finance", "blog"],
}
# Name words of a trade, for records whose industry only repeats the category.
TRADE_WORDS = {
    "food": ["pizza", "bakery", "cake", "restaurant", "food", "biryani", "curry", "kitchen", "cafe", "coffee", "burger", "noodle", "pasta", "sushi", "steak", "bbq", "grill", "tandoori", "dosa", "idli", "sweets", "mithai", "snacks", "pastry", "juice", "tea", "smoothie", "donut"],
    "clothing": ["fashion", "clothing", "apparel", "textile", "wear", "garment", "boutique", "dress", "shirt", "saree", "kurti", "lehenga", "wardrobe"],
    "technology": ["computer", "software", "tech", "digital", "cyber", "data", "cloud", "programming", "coding", "hack", "app", "web", "internet", "network", "server"],
    "healthcare": ["hospital", "medical", "clinic", "pharma", "health", "doctor", "nurse", "surgery", "diagnostic", "dental"],
    "automotive": ["car", "auto", "vehicle", "motor", "garage", "mechanic", "tyre", "battery", "showroom"],
    "hospitality": ["hotel", "motel", "resort", "inn", "lodge", "hostel", "guest house", "homestay"],
}
GENERIC_NAME_WORDS = ["best", "business", "corp", "enterprise", "group", "solutions", "services", "company", "companies", "traders", "dealers", "distributors", "suppliers", "agency", "associates", "partners", "global", "world", "international", "national", "general", "universal", "premium", "prime", "star", "super", "top"]
# These count as well where the industry repeats the category.
GENERIC_NAME_WORDS_STAMPED = ["generic", "quality", "reliable", "trusted", "first", "one"]

QUERY_PREPOSITIONS = [" in ", " near ", " at ", " around ", " from "]
RICH_PREPOSITIONS = [" in ", " near ", " around ", " at ", " from ", " within ", " close to ", " nearby ", " outside ", " inside "]
QUALIFIERS = [
    r"\b(indian|chinese|italian|mexican|japanese|thai|korean|mediterranean|american)\b",
    r"\b(vegetarian|vegan|halal|kosher|organic|gluten.free)\b",
    r"\b(luxury|budget|cheap|expensive|premium|affordable)\b",
    r"\b(family|kid.friendly|romantic|business|casual|fine.dining)\b",
    r"\b(24.hour|24/7|late.night|early.morning|open.now)\b",
    r"\b(top.rated|best|popular|recommended|highly.rated)\b",
    r"\b(delivery|takeout|take.away|dine.in|outdoor.seating)\b",
    r"\b(private|public|government|nonprofit|charity)\b",
    r"\b(startup|small.business|enterprise|corporate|multinational)\b",
    r"\b(digital|online|remote|onsite|hybrid)\b",
    r"\b(certified|licensed|accredited|registered|approved)\b",
]

EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
DISPOSABLE_DOMAINS = ["mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "yopmail.com", "sharklasers.com", "guerrillamailblock.com", "grr.la", "dispostable.com", "10minutemail.com", "trashmail.com", "maildrop.cc"]
NOISE_DOMAINS = ["bing.com", "google.com", "google.co.in", "wikipedia.org", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "linkedin.com", "reddit.com", "quora.com", "medium.com", "copilot.microsoft.com", "microsoft.com"]
NOISE_NAMES = [r"^copilot", r"^microsoft", r"join group conversation", r"^portrait", r"^\[.*\]$", r"^mico$"]

# Industry of a name, the first pattern that is found.
NAME_INDUSTRIES = [
    (r"\beye\s*(?:hospital|care|clinic|center|centre)\b", "Healthcare - Eye Care"),
    (r"\bdental\s*(?:hospital|care|clinic|center|college)\b", "Healthcare - Dental"),
    (r"\borthop[aée]dic\s*(?:hospital|care|clinic)\b", "Healthcare - Orthopedics"),
    (r"\bchild(?:ren)?['']?\s*(?:hospital|care)\b", "Healthcare - Pediatrics"),
    (r"\bmaternity\s*(?:hospital|home|care)\b", "Healthcare - Maternity"),
    (r"\bcancer\s*(?:hospital|care|center)\b", "Healthcare - Oncology"),
    (r"\bheart\s*(?:hospital|care|center)\b", "Healthcare - Cardiology"),
    (r"\bmulti\s*special[ia]ty\s*(?:hospital|care)\b", "Healthcare - Multi Specialty"),
    (r"\bsuper\s*special[ia]ty\s*(?:hospital|care|clinic)\b", "Healthcare - Super Specialty"),
    (r"\bdiagnostic\s*(?:center|centre|lab|labs)\b", "Healthcare - Diagnostics"),
    (r"\bnursing\s*(?:home|college)\b", "Healthcare - Nursing"),
    (r"\bpharmacy|medical\s*store|chemist\b", "Healthcare - Pharmacy"),
    (r"\bhospital\b", "Healthcare"),
    (r"\bclinic\b", "Healthcare"),
    (r"\bmedical\b", "Healthcare"),
    (r"\bhealth(?:care)?\b", "Healthcare"),
    (r"\bsurgical\b", "Healthcare"),
    (r"\bpathology\b", "Healthcare"),
    (r"\bradiology\b", "Healthcare"),
    (r"\bphysiotherapy\b", "Healthcare"),
    (r"\bschool\b", "Education"),
    (r"\bcollege\b", "Education"),
    (r"\buniversity\b", "Education"),
    (r"\bacademy\b", "Education"),
    (r"\binstitute\b", "Education"),
    (r"\beducation\b", "Education"),
    (r"\btraining\b", "Education"),
    (r"\brestaurant\b", "Food & Beverage"),
    (r"\bfood\s*(?:court|court|point|hub|zone)\b", "Food & Beverage"),
    (r"\bhotel\b", "Hospitality"),
    (r"\bdining\b", "Food & Beverage"),
    (r"\bbakery\b", "Food & Beverage"),
    (r"\bcafe|coffee\b", "Food & Beverage"),
    (r"\bstore\b", "Retail"),
    (r"\bshop\b", "Retail"),
    (r"\bretail\b", "Retail"),
    (r"\bmarket\b", "Retail"),
    (r"\bmall\b", "Retail"),
    (r"\bbank\b", "Finance"),
    (r"\bfinance\b", "Finance"),
    (r"\binsurance\b", "Finance"),
    (r"\binvestment\b", "Finance"),
    (r"\bchartered\s*accountant\b", "Finance"),
    (r"\bsoftware\b", "Technology"),
    (r"\bit\s*(?:solution|service|company)\b", "Technology"),
    (r"\btech(?:nology)?\b", "Technology"),
    (r"\bdigital\b", "Technology"),
    (r"\bcyber\b", "Technology"),
    (r"\breal\s*estate\b", "Real Estate"),
    (r"\bproperty\b", "Real Estate"),
    (r"\bconstruction\b", "Construction"),
    (r"\blaw\s*(?:firm|office|associate)\b", "Legal Services"),
    (r"\blegal\b", "Legal Services"),
    (r"\badvocate\b", "Legal Services"),
    (r"\bmanufactur(?:ing|er)\b", "Manufacturing"),
    (r"\bindustri(?:es|al)\b", "Manufacturing"),
    (r"\bfactory\b", "Manufacturing"),
    (r"\btravel\b", "Travel & Tourism"),
    (r"\btour(?:ism)?\b", "Travel & Tourism"),
    (r"\btransport\b", "Transportation & Logistics"),
    (r"\bcourier\b", "Transportation & Logistics"),
    (r"\blogistic\b", "Transportation & Logistics"),
]
# Industry of a page's title and keywords, the first part that is found anywhere.
PAGE_INDUSTRIES = [
    ("hospital", "Healthcare"),
    ("medical", "Healthcare"),
    ("health", "Healthcare"),
    ("clinic", "Healthcare"),
    ("pharma", "Healthcare"),
    ("diagnostic", "Healthcare"),
    ("eye", "Healthcare"),
    ("dental", "Healthcare"),
    ("surgical", "Healthcare"),
    ("nursing", "Healthcare"),
    ("care", "Healthcare"),
    ("school", "Education"),
    ("college", "Education"),
    ("university", "Education"),
    ("academy", "Education"),
    ("institute", "Education"),
    ("engineering", "Education"),
    ("restaurant", "Food & Beverage"),
    ("hotel", "Hospitality"),
    ("travel", "Travel & Tourism"),
    ("bank", "Finance"),
    ("finance", "Finance"),
    ("insurance", "Finance"),
    ("it", "Technology"),
    ("software", "Technology"),
    ("technology", "Technology"),
    ("digital", "Technology"),
    ("tech", "Technology"),
    ("retail", "Retail"),
    ("store", "Retail"),
    ("shop", "Retail"),
    ("manufacturing", "Manufacturing"),
    ("construction", "Construction"),
    ("real estate", "Real Estate"),
    ("legal", "Legal Services"),
    ("law", "Legal Services"),
    ("accounting", "Accounting"),
    ("ca", "Accounting"),
]
SOCIAL_LINKS = {
    "facebook": r"https?://(?:www\.)?facebook\.com/[^\s\"'<>]+",
    "twitter": r"https?://(?:www\.)?twitter\.com/[^\s\"'<>]+",
    "linkedin": r"https?://(?:www\.)?linkedin\.com/(?:company|in)/[^\s\"'<>]+",
    "instagram": r"https?://(?:www\.)?instagram\.com/[^\s\"'<>]+",
    "youtube": r"https?://(?:www\.)?youtube\.com/(?:channel|c|user)/[^\s\"'<>]+",
}
FOUNDED_YEARS = [r"(?:founded|established|since|est\.?)\s*(?:in\s*)?(\d{4})", r"©\s*\d{4}\s*[-–]\s*(\d{4})", r"(\d{4})\s*[-–]\s*(?:present|till|today)"]
COMPANY_SIZES = [r"(\d+[\-\+]?\d*)\s*(?:employees?|staff|team members?)", r"(?:team of|workforce of)\s*(\d+[\-\+]?\d*)"]
PAGE_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PAGE_EMAIL_NOISE = ["example.com", "sentry.io", "wixpress.com", "w3.org", "schema.org", "googleapis.com", "jquery"]

SCORE_VERSION = "1.0"
# Hundredths of the total score.
SCORE_WEIGHTS = {"industry": 20, "size": 10, "location": 15, "technology": 10, "data_quality": 25, "validation": 20}
RECOGNISED_INDUSTRIES = ["healthcare", "education", "finance", "technology", "retail", "manufacturing", "real estate", "legal services", "hospitality", "food & beverage", "travel & tourism", "construction", "transportation & logistics", "accounting"]

SOURCES = ["google_places", "google_search", "google_maps_scraper", "openstreetmap", "web_search", "indiamart", "justdial"]
SELECTABLE_SOURCES = ["openstreetmap", "google_search", "google_maps_scraper", "web_search", "indiamart", "justdial"]
LISTINGS_PER_SOURCE = 200
# What is asked of the places API, and how many places it gives at once.
PLACE_FIELDS = ["id", "displayName", "formattedAddress", "location", "rating", "userRatingCount", "websiteUri", "nationalPhoneNumber", "internationalPhoneNumber", "businessStatus", "types", "googleMapsUri"]
PLACES_PER_PAGE = 20

LEAD_CSV_COLUMNS = [
    "company_name", "industry", "address", "city", "state", "country", "phone", "email", "website", "source", "source_url", "rating", "review_count", "latitude", "longitude", "validation_status",
    "enrichment_description", "enrichment_social_links", "enrichment_founded_year", "industry_score", "size_score", "location_score", "technology_score", "data_quality_score", "validation_score", "total_score", "score_version",
]
RAW_CSV_COLUMNS = ["Name", "Address", "City", "State", "Country", "Phone", "International Phone", "Website", "Rating", "Review Count", "Business Status", "Latitude", "Longitude", "Google Maps URL", "Place ID", "Source", "Retrieved At"]
RAW_CSV_ROWS = 10_000

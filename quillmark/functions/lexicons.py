"""Keyword lists. Fixed values, in their natural order; some end or begin with a blank on purpose."""

# Words of policy and law.
POLICY = (
    "supreme court", "high court", "verdict", "judgment", "judgement", "ruling", "bill", "ordinance", "amendment", "act ",
    "legislation", "parliament", "lok sabha", "rajya sabha", "cabinet", "ministry", "gazette", "notification", "policy",
    "regulation", "regulatory", "guidelines", "mandate", "sanction", "tax", "gst", "budget", "fiscal", "tariff", "subsidy",
    "scheme", "allocation", "rbi", "repo rate", "monetary policy", "sebi", "reserve bank", "election commission",
    "reservation", "rights", "constitution", "petition", "fine", "penalty",
)
# Outrage, celebrity and sports.
DOWNWEIGHT = (
    "viral", "goes viral", "netizens", "trolls", "trolled", "slams", "slammed", "backlash", "twitter reacts",
    "internet reacts", "fans", "meme", "bollywood", "box office", "trailer", "teaser", "actor", "actress", "celebrity",
    "star kid", "wedding", "dating", "girlfriend", "boyfriend", "instagram", "reels", "controversy erupts", "war of words",
    "spat", "shocking", "you won't believe", "sensational", "gossip", "world cup", "champions league", "trophy",
    "medal ceremony", "olympic gold", "playoffs", "grand final", "final match", "halftime show",
)
# Events on the ground.
GROUND = (
    "protest", "march", "rally", "strike", "shutdown", "blockade", "bandh", "clash", "violence", "riot", "lathi", "teargas",
    "water cannon", "arrest", "detained", "custody", "remand", "chargesheet", "fir ", "killed", "injured", "dead",
    "casualties", "victim", "died", "death toll", "resignation", "resigned", "dismissed", "sacked", "suspended", "inquiry",
    "probe", "investigation", "scandal", "allegation", "accused", "verdict", "acquittal", "conviction", "guilty",
    "sentenced", "explosion", "attack", "assault", "raid", "seized",
)
# Places, people and bodies of India.
REGION = (
    "india", "indian", "bharat", "hindustan", "delhi", "new delhi", "mumbai", "bengaluru", "bangalore", "chennai",
    "kolkata", "hyderabad", "pune", "ahmedabad", "lucknow", "jaipur", "modi", "narendra modi", "rahul gandhi", "amit shah",
    "kejriwal", "yogi", "mamata", "stalin", "sonia gandhi", "priyanka gandhi", "parliament", "lok sabha", "rajya sabha",
    "sansad", "monsoon session", "bjp", "congress", "aap", "tmc", "dmk", "aiadmk", "shiv sena", "ncp",
    "supreme court of india", "high court", "cji", "chief justice of india", "rbi", "reserve bank of india", "sebi", "pib",
    "prs india", "niti aayog", "aadhaar", "gst", "cbi", " ed ", "nia", "cag", "kashmir", "ladakh", "manipur", "punjab",
    "tamil nadu", "karnataka", "kerala", "maharashtra", "gujarat", "uttar pradesh", "bihar", "west bengal", "odisha",
    "assam", "andhra pradesh", "telangana", "rajasthan", "madhya pradesh", "haryana", "himachal", "uttarakhand",
    "jharkhand", "chhattisgarh", "goa", "sikkim", "nagaland", "meghalaya", "arunachal pradesh", "tripura", "mizoram",
)
# Signs of controversy.
CONTROVERSY = (
    "opposition", "opposed", "opponent", "rival", "critic", "critics", "criticise", "criticised", "criticize", "criticized",
    "criticism", "denounced", "denounce", "condemned", "condemn", "accuse", "accused", "accusation", "allegation",
    "alleged", "deny", "denies", "denied", "denial", "reject", "rejected", "rejection", "reject the", "controversial",
    "contested", "contest", "dispute", "disputed", "backlash", "outrage", "protest", "protests", "protested", "hypocrisy",
    "hypocritical", "hypocrite", "u-turn", "flip flop", "flip-flop", "contradict", "contradicts", "contradicted",
    "contradictory", "clash", "row", "spat", "war of words", "slam", "slammed", "scandal", "cover up", "cover-up",
    "resign", "resignation", "sacked", "dismissed", "walkout", "boycott", "no confidence",
)
# Page chrome that is no content.
BOILERPLATE = (
    r"you are logged in", r"logged in", r"loading\.\.\.", r"subscribe now", r"subscribed with another email",
    r"already a subscriber", r"active subscription", r"subscription benefits", r"premium stories", r"sign in\b",
    r"\blog in\b", r"create (an|a free) account", r"manage your account", r"gift this article", r"enable javascript",
    r"accept (all )?cookies", r"cookie (policy|settings|preferences)", r"advertisement", r"all rights reserved",
    r"terms (of (use|service)|& conditions)", r"privacy policy", r"follow us on", r"download the app", r"continue reading",
)
# Words without weight in the offline vectoriser and in headline queries.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "in", "is",
    "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "which",
    "will", "with",
)
#: Outlet names that are written in capitals; fixed values.
ACRONYMS = ("ap", "pib", "rbi", "sci", "prs", "un", "us", "usa", "gst", "cjp", "rss")
#: Words without weight in queries made from headlines; fixed values.
HEADLINE_STOP_WORDS = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "as", "by", "over", "with", "amid", "after", "before",
    "into", "from",
)
#: Hosts that answer no fetch without a subscription; fixed values.
PAYWALLED_HOSTS = (
    "www.reuters.com", "reuters.com", "www.bloomberg.com", "bloomberg.com", "www.nytimes.com", "nytimes.com", "www.ft.com",
    "ft.com", "www.wsj.com", "wsj.com", "www.washingtonpost.com", "washingtonpost.com", "www.economist.com",
    "economist.com", "www.pib.gov.in", "pib.gov.in", "www.ndtv.com", "ndtv.com", "newlinesmag.com",
    "www.newlinesmag.com", "www.newyorker.com", "newyorker.com", "www.theatlantic.com", "theatlantic.com",
)
#: Parts of image URLs that are no content, and image hosts that allow no links; fixed values.
JUNK_URL_PARTS = (
    "/logo", "logo.", "logo-", "-logo", "/favicon", "favicon.", "/icon", "-icon.", "sprite", "/ad-", "/ads/", "adserver",
    "doubleclick", "1x1.", "pixel.", "beacon", "avatar", "/subscribe", "/paywall",
)
JUNK_HOSTS = ("lookaside.fbsbx.com", "scontent.fbcdn.net", "pbs.twimg.com")

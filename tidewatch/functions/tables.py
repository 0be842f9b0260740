"""Word lists, patterns and tables of the rule classifiers."""

from __future__ import annotations

# Results depend on these words, patterns and numbers, and on their order.

#: Category rules; the first match wins.
CATEGORY_RULES = [
    ("breaking", r"\b(breaking|urgent|just in|alert|developing story|emergency|evacuation order|state of emergency|major incident)\b"),
    ("disaster", r"\b(earthquake|tsunami|hurricane|typhoon|flood|wildfire|eruption|tornado|avalanche|landslide|cyclone|blizzard|drought)\b"),
    ("conflict", r"\b(war\b|attack(?:ed|s)?|killed|airstrike|missile strike|bomb(?:ing|ed)|gunfire|shelling|offensive\b|frontline|casualt(?:y|ies)|armed clash|combat|insurgent|firefight)\b"),
    ("security", r"\b(military exercise|defense polic|arms (?:deal|sale|trade)|naval deployment|intelligence|espionage|surveillance|defense budget|troops deploy|military aid)\b"),
    ("elections", r"\b(election|vote|ballot|campaign|president|prime minister|parliament|congress|referendum|polling)\b"),
    ("climate", r"\b(climate|emissions|temperature|arctic|glacier|carbon|warming|sea level|deforestation|biodiversity|coral reef)\b"),
    ("health", r"\b(outbreak|virus|disease|pandemic|vaccine|hospital|health|who|cdc|pathogen|epidemic|public health|mortality|infection)\b"),
    ("economy", r"\b(stock|market|economy|gdp|inflation|federal reserve|interest rate|trade|sanctions|currency|recession|debt|fiscal|imf)\b"),
    ("security", r"\b(cyber|hack|ransomware|data breach|phishing|malware|vulnerability|exploit|zero.day|cve|infosec)\b"),
    ("technology", r"\b(ai|artificial intelligence|tech|startup|silicon valley|semiconductor|quantum|robotics|autonomous|neural)\b"),
    ("space", r"\b(space|nasa|rocket|satellite|mars|moon|astronaut|orbit|launch|iss|spacex|esa|asteroid|telescope)\b"),
    ("science", r"\b(research|study|discovery|experiment|scientists|university|published|peer.reviewed|clinical trial|genome|physics|chemistry)\b"),
    ("geopolitics", r"\b(sanctions|diplomat|treaty|nato|un|security council|foreign minister|geopolit|alliance|bilateral|multilateral)\b"),
    ("culture", r"\b(culture|film|music|art|award|festival|celebrity|sports|football|soccer|olympics|world cup|nba|nfl|cricket|tennis|religion|protest|movement|activism)\b"),
]
SEVERITY_RULES = [
    ("critical", r"\b(mass casualt|nuclear|chemical weapon|catastrophic|collapse|emergency declared|massacre)\b"),
    ("high", r"\b(killed\s+\d|deaths?\s+toll|major\s+(?:attack|earthquake|flood|explosion)|significant\s+casualt|breaking|urgent|alert)\b"),
    ("medium", r"\b(injured|damage|concern|warning|developing|troops|military|missile|sanctions)\b"),
]
TAG_RULES = [
    ("USA", r"\bunitedstates|usa|america|washington\b"), ("China", r"\bchina|beijing|chinese\b"), ("Russia-Ukraine", r"\brussia|moscow|russian|ukraine|ukrainian\b"),
    ("Middle East", r"\bisrael|gaza|palestine|hamas\b"), ("India", r"\bindia|new delhi|indian\b"), ("Europe", r"\beurope|eu|european union|brussels\b"),
    ("Philippines", r"\bphilippines|manila|philippine\b"), ("ClimateChange", r"\bclimate change|global warming\b"), ("AI", r"\bartificial intelligence|ai\b"),
    ("Crypto", r"\bcryptocurrency|bitcoin|ethereum\b"), ("PeaceTalks", r"\bceasefire|peace talks|negotiations\b"),
]
#: Scripts by first and last code point, and stop words of languages in Latin script; ties go to the first language.
SCRIPTS = [("zh", 0x4E00, 0x9FFF), ("ja", 0x3040, 0x30FF), ("ko", 0xAC00, 0xD7AF), ("ar", 0x0600, 0x06FF), ("ru", 0x0400, 0x04FF), ("hi", 0x0900, 0x097F), ("el", 0x0370, 0x03FF), ("th", 0x0E00, 0x0E7F), ("he", 0x0590, 0x05FF)]
LANGUAGE_WORDS = {
    "es": ["que", "del", "los", "las", "una", "por", "con", "para"],
    "fr": ["les", "des", "une", "dans", "sur", "est", "pas", "aux"],
    "de": ["die", "der", "das", "und", "ist", "ein", "nicht", "mit"],
    "pt": ["que", "uma", "não", "com", "dos", "são", "para", "por"],
    "it": ["che", "del", "una", "con", "per", "non", "dei", "sul"],
}
#: Ladders of news reports; the source's own category is kept where none matches.
NEWS_SEVERITY = [
    ("critical", r"\b(mass\s+casualt|nuclear\s+(?:strike|attack|war|explosion)|genocide|war\s+declared|pandemic\s+declared|catastrophic|world\s+war|chemical\s+weapon|biological\s+weapon|dirty\s+bomb)\b"),
    ("high", r"\b(killed|dead|deaths|bombing|missile\s+strike|air\s+strike|earthquake|tsunami|hurricane|invasion|coup|emergency\s+declared|terror\s+attack|assassination|refugee\s+crisis|famine|outbreak)\b"),
    ("medium", r"\b(arrested|sanction|protest|crisis|clash|conflict|fighting|forces|offensive|troops|ceasefire|election|summit|verdict|breaking)\b"),
]
NEWS_CATEGORY = [
    ("health", r"\b(pandemic|outbreak|virus|disease|epidemic|vaccine|who|health\s+emergency|pathogen|mpox|ebola|flu|covid)\b"),
    ("disaster", r"\b(earthquake|tsunami|hurricane|typhoon|cyclone|wildfire|flood|eruption|volcano|tornado|blizzard|drought|disaster)\b"),
    ("elections", r"\b(election|vote|voting|ballot|democracy|referendum|poll|candidate|campaign|inauguration)\b"),
    ("economy", r"\b(stock\s+market|recession|inflation|gdp|central\s+bank|interest\s+rate|economy|trade\s+war|tariff|sanction|oil\s+price|crypto)\b"),
    ("technology", r"\b(ai\s+|artificial\s+intelligence|cybersecurity|hack|data\s+breach|tech\s+giant|silicon\s+valley|openai|spacex|nasa)\b"),
    ("climate", r"\b(climate\s+change|global\s+warming|carbon|emissions|cop[0-9]+|fossil\s+fuel|renewable\s+energy|deforestation)\b"),
    ("conflict", r"\b(war|invasion|airstrike|missile|troops|military|casualties|conflict|nato|ceasefire|bombing|killed|shelling)\b"),
    ("space", r"\b(space\s+launch|rocket|satellite|iss|moon|mars|nasa|esa|spacex|boeing\s+starliner|astronaut)\b"),
    ("security", r"\b(cyber\s+attack|ransomware|malware|espionage|spy|intelligence|terror)\b"),
]
#: Words that keys of events leave out.
EVENT_STOP_WORDS = (
    "a an the in on at to for of and or is are was were be been has have had do does did will would could should may might shall "
    "not no but if so as by with from up out that this it its they their we our new says said report reports update breaking"
).split()
#: Sentences that claim something, by kind; the group is the claim.
CLAIM_RULES = [
    ("statistical", r"(?i)(?:^|[.!?]\s+)([^.!?]*?\b(?:\d+(?:\.\d+)?%|\d{1,3}(?:,\d{3})+|\d+\s*(?:million|billion|trillion|thousand|hundred))\b[^.!?]*[.!?])"),
    ("attribution", r"(?i)(?:^|[.!?]\s+)([^.!?]*?\b(?:said|claimed|stated|reported|announced|confirmed|denied|warned|revealed|disclosed|alleged)\b[^.!?]*[.!?])"),
    ("causal", r"(?i)(?:^|[.!?]\s+)([^.!?]*?\b(?:because|caused by|resulted? in|led to|due to|attributed to|as a result of|contributed to)\b[^.!?]*[.!?])"),
    ("predictive", r"(?i)(?:^|[.!?]\s+)([^.!?]*?\b(?:will|expected to|likely to|forecast|projected|predicted|anticipated|estimated to)\b[^.!?]*[.!?])"),
    ("factual", r"(?i)(?:^|[.!?]\s+)([^.!?]*?\b(?:is the (?:first|largest|smallest|most|least|only|highest|lowest)|has been|was found|are considered|officially)\b[^.!?]*[.!?])"),
]
#: Confidence in a claim, in hundredths: its base, what patterns of its text add, what its kind adds, and what lengths below and above bounds add.
CLAIM_BASE = 50
CLAIM_POINTS = [
    (r"[0-9]", 15), (r"according to|data shows|study found|research indicates", 20), (r"percent|%|million|billion|thousand", 15), (r"official|confirmed|report|published", 10),
    (r"i think|maybe|possibly|might|could be|seems like|not sure", -20), (r"in my opinion|personally|i feel|i believe", -25),
]
CLAIM_KINDS, CLAIM_SHORT, CLAIM_LONG = {"statistical": 10, "attribution": 5, "predictive": -5}, (30, -10), (100, 5)
#: Words of a snippet that contradict a claim.
CONTRADICTIONS = [
    "denied", "refuted", "contradicted", "false", "incorrect", "debunked", "disputed", "rejected", "untrue", "misleading", "misinformation", "retracted", "not true", "no evidence", "unsubstantiated", "fabricated",
    "disproven",
]
#: What spoken text loses, in this order.
FILLERS = [r"\b(?:um|uh|erm|hmm|like|you know|i mean|sort of|kind of|basically|literally|right|okay|so yeah)\b", r"\b(?:and uh|but um|so uh|well uh)\b"]
CLAIM_LEAST, CLAIM_MOST, CLAIMS, CLAIM_CONTEXT = 20, 500, 50, 100
#: Titles that bait clicks, and domains that are known for mass-produced texts.
CLICKBAIT = [
    r"\byou won't believe\b", r"\bshocking(ly)?\b", r"\bbreaking(?:[^\w-]|$)", r"\b(top|best)\s+\d+\b", r"\bthis one (trick|thing|secret)\b", r"\bwhat happened next\b",
    r"\beveryone is (talking|saying)\b", r"\bviral\b.*\b(now|today)\b", r"!{2,}",
]
CONTENT_FARMS = (
    "dailytrendingnews.net thenewsglobe.net newsnow24.co morningtidings.com usanewsflash.com worldnewsdaily24.com breakingnewsreporter.com globalheadlines24.net politicswatch24.com "
    "newsbreakfeed.co usadailytimes.com nationalnewsbrief.com trendingreporters.com fastbreaking.news thepoliticsnews.com realclearnewsfeed.com dailynewspulse.net theamericas24.com "
    "worldpresswire.io urgentdispatch.net allnewsupdate.net headlineinsider.com justintrendstoday.com currentnewspaper.net flashbulletinnews.com"
).split()
#: Leanings of outlets, -1 to 1; the labels' bounds; domains that are neutral; country domains with state media; words of a name.
BIAS = {
    "jacobinmag.com": -0.90, "truthout.org": -0.85, "counterpunch.org": -0.88, "democracynow.org": -0.82,
    "nytimes.com": -0.50, "washingtonpost.com": -0.55, "theguardian.com": -0.55, "msnbc.com": -0.72, "cnn.com": -0.58, "huffpost.com": -0.68, "vox.com": -0.62, "theatlantic.com": -0.48,
    "slate.com": -0.60, "motherjones.com": -0.72, "npr.org": -0.22, "bbc.com": -0.18, "bbc.co.uk": -0.18, "apnews.com": -0.12, "usatoday.com": -0.20, "time.com": -0.28, "axios.com": -0.15,
    "reuters.com": 0.00, "pbs.org": -0.08, "csmonitor.com": 0.02, "thehill.com": 0.05, "wsj.com": 0.30, "economist.com": 0.20, "politico.com": 0.15, "businessinsider.com": 0.18,
    "foxnews.com": 0.65, "nypost.com": 0.55, "breitbart.com": 0.78, "dailymail.co.uk": 0.58, "washingtontimes.com": 0.62, "oann.com": 0.90, "thegatewaypundit.com": 0.95, "infowars.com": 1.00,
}
NEUTRAL_ENDS, STATE_ENDS = [".gov", ".mil", ".edu", ".int", ".un.org"], [".ru", ".cn", ".ir", ".kp"]
LEFT_WORDS = (
    "progress progressive resist liberal democrat labor labour socialist peoples people equality justice solidarity leftist leftnews dissent alternet truthdig commondreams intercept theintercept"
).split()
RIGHT_WORDS = (
    "patriot patriots conservative gop republican liberty freedom eagle rightside rightnews breitbart daily-wire dailywire epoch newsmax rebel revolt nationalist tradnews townhall redstate pjmedia "
    "americanthinker frontpage"
).split()
#: Kinds of threats and their origins by words of a title; the first match wins.
THREATS = [
    ("hypersonic", ["hypersonic", "zircon", "kinzhal", "df-17", "avangard"]),
    ("ballistic", ["icbm", "ballistic missile", "shahab", "hwasong", "df-41", "df-5"]),
    ("cruise", ["tomahawk", "kalibr", "scalp", "storm shadow", "cruise missile"]),
    ("drone", ["drone", "uav", "shahed", "bayraktar", "ucav", "kamikaze drone"]),
    ("rocket", ["rocket", "qassam", "katyusha", "grad", "rpg", "mortar"]),
]
ORIGINS = [
    ("Russia", ["russia", "russian", "kremlin"]), ("Iran", ["iran", "iranian", "irgc"]), ("North Korea", ["north korea", "dprk", "pyongyang", "kim jong"]), ("China", ["china", "chinese", "pla"]),
    ("Ukraine", ["ukraine", "ukrainian"]), ("Israel", ["israel", "idf"]), ("Non-State Actor", ["hamas", "hezbollah", "houthi"]),
]
#: Carriers: their fleet and the names by which titles mean them; and words of ships that hide.
FLEETS = [
    ("Atlantic Fleet / 2nd Fleet", ["Gerald Ford", "Ford", "CVN-78", "CVN 78"]), ("7th Fleet", ["George Washington", "GW", "CVN-73", "CVN 73"]),
    ("Atlantic Fleet / 2nd Fleet", ["Harry Truman", "Truman", "HST", "CVN-75", "CVN 75"]), ("Pacific Fleet / 3rd Fleet", ["Theodore Roosevelt", "TR", "CVN-71", "CVN 71"]),
    ("Pacific Fleet / 3rd Fleet", ["Abraham Lincoln", "Lincoln", "CVN-72", "CVN 72"]), ("Pacific Fleet / 3rd Fleet", ["Carl Vinson", "Vinson", "CVN-70", "CVN 70"]),
    ("Atlantic Fleet / 2nd Fleet", ["Dwight Eisenhower", "Eisenhower", "Ike", "CVN-69", "CVN 69"]), ("Pacific Fleet / 3rd Fleet", ["Nimitz", "CVN-68", "CVN 68"]),
    ("Pacific Fleet / 3rd Fleet", ["John Stennis", "Stennis", "CVN-74", "CVN 74"]), ("Pacific Fleet / 3rd Fleet", ["Ronald Reagan", "Reagan", "RR", "CVN-76", "CVN 76"]),
    ("Atlantic Fleet / 2nd Fleet", ["George Bush", "H.W. Bush", "GHWB", "CVN-77", "CVN 77"]),
]
DARK_SHIPS = ["dark ship", "ais off", "ais gap", "transponder off", "transponder disabled", "dark vessel", "untracked vessel"]
#: Topics of a scene by words; ties go to the first.
TOPICS = {
    "Economy": ["economy", "gdp", "inflation", "unemployment", "market", "trade", "fiscal", "monetary"],
    "Security": ["military", "defense", "security", "attack", "war", "conflict", "weapon", "missile"],
    "Health": ["health", "pandemic", "vaccine", "hospital", "disease", "medical", "who"],
    "Climate": ["climate", "carbon", "emissions", "temperature", "renewable", "energy", "environment"],
    "Technology": ["technology", "ai", "artificial intelligence", "cyber", "digital", "data", "software"],
    "Politics": ["election", "vote", "congress", "parliament", "legislation", "bill", "policy"],
    "Human Rights": ["rights", "freedom", "democracy", "protest", "refugee", "humanitarian"],
}
#: Titles before a name, of which up to two go.
TITLES = [
    "president", "prime minister", "minister", "deputy minister", "secretary", "general secretary", "vice president", "king", "queen", "prince", "princess", "crown prince", "emperor", "sultan", "emir",
    "sheikh", "general", "admiral", "colonel", "commander", "captain", "dr", "prof", "professor", "ambassador", "senator", "governor", "mayor", "chancellor", "speaker", "chairman", "chairwoman",
    "chairperson", "ceo", "cto", "cfo", "former", "acting", "interim", "chief",
]
#: Short titles that go before all others, with or without a full stop.
HONORIFIC = r"^(mr|mrs|ms|dr|prof)\.?\s+"
#: Merges of names: similarities of the kinds of match, and those from which they are merged.
MERGE_SIMILARITY = {"title_strip": 0.95, "person": 0.88, "organisation": 0.82}
MERGE_FROM = {"title_strip": 0.90, "containment": 0.85, "trigram": 0.80}
#: Categories in which a corroborated report of medium severity rises.
STRATEGIC = ["conflict", "geopolitics", "security", "disaster", "health", "breaking", "economy"]
#: Places by words of a report, the first match wins: name, country, latitude, longitude, words.
PLACES = [
    ("Ukraine", "UA", 50.45, 30.52, ["ukraine", "kyiv", "zaporizhzhia", "kharkiv"]), ("Moscow, Russia", "RU", 55.75, 37.62, ["russia", "moscow", "kremlin"]),
    ("Israel", "IL", 31.77, 35.22, ["israel", "tel aviv", "jerusalem", "idf"]), ("Gaza", "PS", 31.50, 34.47, ["gaza", "palestin", "hamas", "west bank"]),
    ("Beijing, China", "CN", 39.91, 116.39, ["china", "beijing", "shanghai", "ccp", "xi jinping"]), ("Taipei, Taiwan", "TW", 25.03, 121.57, ["taiwan", "taipei"]),
    ("Pyongyang, North Korea", "KP", 39.02, 125.75, ["north korea", "pyongyang", "dprk", "kim jong"]), ("Tehran, Iran", "IR", 35.69, 51.39, ["iran", "tehran", "irgc"]),
    ("Riyadh, Saudi Arabia", "SA", 24.69, 46.72, ["saudi arabia", "riyadh", "aramco"]), ("Damascus, Syria", "SY", 33.51, 36.29, ["syria", "damascus", "aleppo"]),
    ("New Delhi, India", "IN", 28.60, 77.21, ["india", "new delhi", "modi", "bjp", "mumbai"]), ("Islamabad, Pakistan", "PK", 33.72, 73.06, ["pakistan", "islamabad", "lahore", "karachi"]),
    ("Tokyo, Japan", "JP", 35.68, 139.69, ["japan", "tokyo", "osaka", "abe"]), ("Berlin, Germany", "DE", 52.52, 13.41, ["germany", "berlin", "bundestag"]),
    ("Paris, France", "FR", 48.85, 2.35, ["france", "paris", "macron", "elysee"]), ("London, United Kingdom", "GB", 51.50, -0.12, ["united kingdom", "london", "britain", "uk", "westminster"]),
    ("Washington D.C., USA", "US", 38.90, -77.04, ["united states", "washington", "white house", "pentagon", "congress", "biden", "trump"]),
    ("Brasília, Brazil", "BR", -15.79, -47.88, ["brazil", "brasilia", "sao paulo", "lula"]), ("Africa", "ZZ", 0.00, 20.00, ["africa", "sahel", "west africa", "sub-saharan"]),
    ("Khartoum, Sudan", "SD", 15.55, 32.53, ["sudan", "khartoum"]), ("Addis Ababa, Ethiopia", "ET", 9.02, 38.75, ["ethiopia", "addis ababa", "tigray"]),
    ("Mogadishu, Somalia", "SO", 2.05, 45.34, ["somalia", "mogadishu", "al-shabaab"]), ("Naypyidaw, Myanmar", "MM", 16.80, 96.16, ["myanmar", "burma", "rangoon", "naypyidaw"]),
    ("Ankara, Turkey", "TR", 39.93, 32.86, ["turkey", "ankara", "istanbul", "erdogan"]), ("Caracas, Venezuela", "VE", 10.49, -66.88, ["venezuela", "caracas", "maduro"]),
    ("Mexico City, Mexico", "MX", 19.43, -99.13, ["mexico", "mexico city", "pemex"]),
]

"""Lexicons and rule tables. Every rule set is data: replace it to run the same operators on another beat.

Patterns are Java regular expressions; ``(?i)`` marks those that ignore case.
"""

from __future__ import annotations

# ---- Fixed values: relevance lexicons ----
RELEVANCE = r"(?i)insur|underwrit|reinsur|actuar|policyholder"
TECH_ANGLE = r"(?i)insurtech|fintech|technolog|platform|digital|software|\bapp\b|\bAPI\b|\bAI\b|artificial intelligence|machine learning|\bLLM\b|algorithm|automat|data|analytics|cyber|embedded|telematics|\bSaaS\b|startup|start-up|venture|funding|raise[sd]?\b|inves(?:t|tment)|acqui|partner|launch"
TECH_CORE = r"(?i)insurtech|fintech|technolog|platform|digital|software|\bapp\b|\bAPI\b|\bAI\b|artificial intelligence|machine learning|\bLLM\b|algorithm|automat|analytics|cyber|embedded|telematics|\bSaaS\b|no-code|chatbot|startup|start-up|scale-?up"
INSURANCE_ROUND = RELEVANCE + r"|\bbroker(?:s|age)?\b|\bcoverage\b|\bclaims?\b|\bpremiums?\b|\bMGA\b|\bcarriers?\b|\bemployee benefits\b|\bbenefits platform\b|\bcat bond\b|\bactuar"
INSURANCE_DEAL = RELEVANCE + r"|\bbroker(?:s|age)?\b|\bunderwrit|\bclaims?\b|\bpremiums?\b|\bMGA\b|\bcarriers?\b|\bactuar|\badjust(?:er|ing)\b|\breinsur|\bannuit|\bpolicyholder"
SKIP_URL = r"(?i)/event-info/|/events?/|/webinar"
NO_REUSE = r"(?i)copyright to |infringement has occurred|all rights reserved|may not be (?:reproduced|republished|redistributed)"

# ---- Fixed values: labels in chip order, their patterns and the subjects they stand for ----
_MONEY = r"(?:(?:US|C|CA|A|AU|NZ|S|HK)?[$€£₹¥]|\b(?:USD|EUR|GBP|INR|CAD|AUD|SGD|Rs|RM)\b|\b\d[\d,.]*\s?(?:million|billion|thousand|mn|bn|crore|lakh|[kmb])\b)"
_RAISE = r"(?:rais(?:e|es|ed|ing)|secur(?:e|es|ed)|land(?:s|ed)?|clos(?:e|es|ed)|bag(?:s|ged)?|nab(?:s|bed)?|pour(?:s|ed)?|pocket(?:s|ed)?|chomp(?:s|ed)?|scoop(?:s|ed)?|score(?:s|d)?|haul(?:s|ed)?|draw(?:s|n)?|attract(?:s|ed)?|receiv(?:e|es|ed)|get(?:s)?|invest(?:s|ed)?|bet(?:s)?|back(?:s|ed)|commit(?:s|ted)?|extend(?:s|ed)?|snag(?:s|ged)?|pull(?:s|ed)? in|picks? up|brings? in)"
TAGS = [
    ("Funding", rf"(?i)({_RAISE}\s+(?:\S+\s+){{0,3}}{_MONEY}|{_MONEY}[^.;]{{0,30}}?\b(?:rais(?:e|ed)|round|funding|financing|seed|series [a-z]\b)\b|fundrais|funding round|seed funding|seed round|seed capital|series [a-z]\b|pre-?seed|in funding|funding from|funding led|funding to|growth (?:funding|financing|equity|capital)|venture (?:capital|round|funding|debt)|\bVC round\b|valuation|investment round|capital raise|backed by|led by|financing round|\bfunding\b|oversubscribed)"),
    ("M&A", r"(?i)(acquir|acquisition|merg(e|es|er|ing)|buyout|takeover|to buy|snaps up|buys )"),
    ("Partnerships", r"(?i)(partner|partnership|teams? up|collaborat|joins forces|alliance|tie-?up|taps |selects |integrat|to distribute|distribution deal|powers )"),
    ("Product & Launches", r"(?i)(launch|unveil|rolls? out|introduc|debut|releases?|goes live|new (product|platform|tool|app|solution|feature)|expands? (in)?to|now available)"),
    ("AI & Automation", r"(?i)(\bAI\b|artificial intelligence|machine learning|\bML\b|gen(erative)?[ -]?ai|\bLLM\b|automat|chatbot|algorithm|predictive|\bGPT\b|agentic|copilot|no-code)"),
    ("Embedded", r"(?i)(embedded insurance|embedded finance|insurance as a service|api-first|point[- ]of[- ]sale insurance|bancassurance|at checkout)"),
    ("Cyber", r"(?i)(cyber|ransomware|data breach|malware|phishing|cyberattack|cyber risk)"),
    ("Claims & Underwriting", r"(?i)(claims?\b|underwrit|pricing|risk assessment|loss adjust|actuar|fraud|\bfnol\b|first notice of loss)"),
    ("Health & Life", r"(?i)(health ?insur|life insur|health ?tech|healthcare|medicare|medicaid|employee benefits|group health|disability insur|dental|telehealth|wellness)"),
    ("Auto & Mobility", r"(?i)(auto insur|motor insur|car insur|telematics|usage-based|\bUBI\b|fleet|\bEV\b|autonomous (?:vehicle|driving|car|truck|fleet|taxi|ride|mobility)|robotaxi|self-driving|mobility|driver|vehicle)"),
    ("Property & Cat", r"(?i)(property insur|homeowners?|property.and.casualty|\bP&C\b|catastrophe|\bcat bond\b|reinsur|climate|flood|wildfire|hurricane|natural disaster|parametric|commercial property)"),
    ("Regulation", r"(?i)(regulat|complian|lawsuit|\bcourt\b|department of insurance|licens|sanction|fined|penalty|legislat|\bNAIC\b|policyholder protection)"),
    ("Leadership", r"(?i)(appoint|names? (new )?(ceo|cfo|cto|coo|chair|president|head|chief)|hires?\b|joins as|steps down|resign|(?<!financial )promot(?:e|es|ed|ion|ions)\b|new ceo|board of directors|expands leadership)"),
]
FALLBACK_TAG = "Industry"
SUBJECTS = {
    "Funding": "Insurtech funding", "M&A": "Insurance M&A", "Partnerships": "Insurance partnerships", "Product & Launches": "Insurance product launches",
    "AI & Automation": "AI in insurance", "Embedded": "Embedded insurance", "Cyber": "Cyber insurance", "Claims & Underwriting": "Insurance claims and underwriting",
    "Health & Life": "Health and life insurance", "Auto & Mobility": "Auto insurance and mobility", "Property & Cat": "Property and catastrophe insurance",
    "Regulation": "Insurance regulation", "Leadership": "Insurance leadership moves", "Industry": "Insurtech",
}

# ---- Fixed values: currencies (US dollars each), their marks and the multipliers (in millions) ----
RATES = {"USD": 1, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "NZD": 0.60, "SGD": 0.74, "HKD": 0.128, "CHF": 1.12, "JPY": 0.0067, "INR": 0.012, "MYR": 0.23, "ZAR": 0.055, "AED": 0.272, "SAR": 0.267, "BRL": 0.18}
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}
DOLLAR_PREFIX = {"US": "USD", "C": "CAD", "CA": "CAD", "A": "AUD", "AU": "AUD", "NZ": "NZD", "S": "SGD", "SG": "SGD", "HK": "HKD", "R": "ZAR", "RM": "MYR"}
CODES = {**{c: c for c in RATES}, "RS": "INR", "RM": "MYR"}
CURRENCY_WORDS = {"euro": "EUR", "pound": "GBP", "sterling": "GBP", "rupee": "INR", "ringgit": "MYR", "rand": "ZAR", "yen": "JPY", "franc": "CHF", "real": "BRL", "reais": "BRL", "dirham": "AED", "riyal": "SAR"}
MULTIPLIERS = {"trillion": 1e6, "billion": 1e3, "million": 1, "thousand": 1e-3, "crore": 10, "lakh": 0.1, "cr": 10, "mn": 1, "bn": 1e3, "k": 1e-3, "m": 1, "b": 1e3}
#: Longest unit first: an alternation takes the first that fits.
FIGURE = r"(?i)(?:\b(USD|EUR|GBP|INR|CAD|AUD|NZD|SGD|HKD|CHF|JPY|MYR|ZAR|AED|SAR|BRL|Rs|RM)\.?\s*)?([$€£₹¥])?\s*(\d[\d,]*(?:\.\d+)?)[\s -]*(trillion|billion|million|thousand|crore|lakh|cr|mn|bn|[kmb])?\b(?:[\s -]*(euros?|pounds?|sterling|rupees?|ringgit|rand|yen|francs?|reais|real|dirhams?|riyals?|dollars?|USD|EUR|GBP|INR|CAD|AUD|NZD|SGD|HKD|CHF|JPY|MYR|ZAR|AED|SAR|BRL)\b)?"
VALUATION_AFTER = r"(?i)^[\s,;:–—-]*(?:(?:post|pre)[- ]?money\s+)?(?:valuation|market cap)\b(?!\s+(?:of|at|to)\b)"
VALUATION_BEFORE = r"(?i)(?:valued(?:\s+at)?|valuation\s+(?:of|at|to)|\bworth|market cap\s+of|\bvalue[sd]?\s+[^$]{0,40}?\bat)\s+(?:a|an|about|roughly|nearly|around|some|over|almost)?\s*$"
VALUATION_AT = r"(?i)^[^$€£₹]{0,25}\bat\s+(?:a\s+|an\s+)?$"
CAP_M = 1000.0

# ---- Fixed values: rounds ----
STAGES = [
    ("Pre-seed", r"(?i)pre[-\s]?seed"), ("Pre-Series A", r"(?i)pre[-\s]?series[-\s]?a\b"), ("Pre-Series B", r"(?i)pre[-\s]?series[-\s]?b\b"), ("Pre-Series C", r"(?i)pre[-\s]?series[-\s]?c\b"),
    ("Seed", r"(?i)\bseed\b"), ("Series A", r"(?i)series[-\s]?a\b"), ("Series B", r"(?i)series[-\s]?b\b"), ("Series C", r"(?i)series[-\s]?c\b"), ("Series D", r"(?i)series[-\s]?d\b"), ("Series E+", r"(?i)series[-\s]?[e-z]\b"),
    ("Venture debt", r"(?i)venture debt|debt (facility|financing|round)|credit facility"), ("Growth", r"(?i)growth (round|equity|capital|financing|investment)|late[- ]stage"), ("Strategic", r"(?i)strategic (investment|round|funding|stake)"),
]
MONEY_HINT = r"(?i)[$€£₹¥]\s?\d|\b\d[\d,.]*\s?(?:million|billion|trillion|thousand|mn|bn|crore|lakh|[kmb])\b|\b(?:USD|EUR|GBP|INR|CAD|AUD|SGD|Rs)\.?\s?\d"
ROUND_HINT = r"(?i)rais(?:e|es|ed|ing)|fundrais|funding|\bfunds?\b|\bround\b|\bseed\b|series [a-z]\b|\binvest|\bback(?:s|ed|ing)\b|\bsecur(?:e|es|ed)\b|\bclos(?:e|es|ed)\b|\blands?\b|\bbags?\b|\bnets?\b|\bnabs?\b|\bpours?\b|\bpockets?\b|\bcommits?\b|\bfinanc(?:e|es|ed|ing)\b|\bcapital\b|\bvaluation\b|\bstake\b|\bcheque\b|\bticket\b|\bvaluat"
STALE_RECORD = r"(?i)(?:digital (?:insurance|wealth)|cx tech)\s+forum"
_NOISE = [
    r"market (size|share|report|research|value|outlook|forecast)", r"to (reach|exceed|hit|surpass|touch|cross) \$", r"\bforecast(ed)?\b", r"\bcagr\b", "projected", "estimated to",
    r"expected to (reach|grow|hit|exceed|rise)", "anticipated to", r"by 20\d\d", r"halv(e|ed|es|ing)", "rebound", r"\bdrop(ped|s)?\b", r"\bfell\b", r"\brose\b",
    r"\b[1-4]H\d\d\b", r"\b[1-4]Q\d\d\b", r"\bH[12]\b", r"\bQ[1-4]\b", r"full[- ]year", r"year[- ]on[- ]year", "quarterly", "annual(ly)?", "as many as", r"a total of\s*\$", "raised across", r"across \d+",
    r"\b\d+\s+(?:[A-Za-z]+\s+)?(?:startups|deals|companies|rounds)\b", r"\btops?\s*\$",
    r"\b(?:funding|investment|deal (?:activity|volume)|deals)\s+(?:reach(?:es|ed)?|hits?|total(?:s|led)?|stood|climb(?:s|ed)?|jump(?:s|ed)?|surge[sd]?|slid|slump(?:s|ed)?|grew|dipped)",
    r"\b(?:insurtech|fintech|insurance|sector|market|ecosystem|industry)\s+(?:draws|drew|attracts?|attracted|sees|saw|records?|pulls? in|posts?)\s+(?:[A-Z]{0,2}[$€£₹]|\d)",
    r"\bIPO\b", r"\bresult of placing\b", r"\bregistered direct offering\b", r"\bgross proceeds\b", r"\brights issue\b", "first close", "investible capital", r"\bfund (?:I{1,3}|IV|VI{0,3}|IX|X)\b",
    r"\bfund (?:trio|family|vehicle)\b", r"\b(?:rais|clos|secur|announc|launch|unveil|open)\w*\s+(?:(?!\b(?:led|from|by|with|backed|and)\b)[^,;])*?\bfund\b(?!ing|ed|s\b)", r"\bboosts? .{0,20}\bfund\b", r"\bexpands? .{0,25}\bfund\b",
    r"\bcommits?\s+(?:[A-Z]{0,2}[$€£₹¥]|Rs\.?\s*\d|\d)", r"\b(?:boost|increase|up|expand|grow|acquire|buy)\w*\s+(?:its\s+)?(?:[\w-]+\s+){0,2}stake\b",
    r"\binvests?\s+[^,;]{0,25}\bin\s+(?:AI\b|R&D|its\s|new\s|tech(?:nology)?\b|digital\b|expansion|growth|infrastructure)", r"\bcapacity\b", r"\brefinanc", r"\bloan repayment\b",
    r"\bcould (?:secure|raise|land|close|net|get|bag)\b", r"\bin talks (?:to|for|over|with)\b", r"\bnearing\b", r"\bnears\b",
    r"\b(?:seeks?|seeking|plans?|planning|hopes?|hoping|aims?|aiming|eyes?|eyeing|targets?|targeting|set|poised|expected|looking)\s+(?:to\s+)?(?:raise|secure|close|land)\b",
    r"\beyes?\s+(?:a\s+|an\s+|up\s+to\s+)?[$€£₹]", r"\breportedly (?:rais|seek|near|in talks)", r"\bup to\s*[$€£₹]", r"\bmay raise\b", r"\bwould raise\b", r"\bto raise\b", r"\bto invest\b", r"\btargets?\s+(?:[A-Z]{0,2}[$€£₹¥]|Rs\.?\s*\d|₹|\d)",
]
#: Most of these begin at the edge of a word: one test for all of them inside words, where no such one begins.
MARKET_NOISE = r"(?i)\b(?:" + "|".join(p[2:] for p in _NOISE if p.startswith(r"\b")) + ")|" + "|".join(p for p in _NOISE if not p.startswith(r"\b"))
#: The literal rule also rejects headlines whose backer is a fund; it is the ``literal`` setting of round_noise().
FUND_ANYWHERE = r"(?i)(?:venture|vc|investment|growth|debt|insurtech|fintech) fund\b"

# ---- Fixed values: deals ----
SOFT_ACQUISITION = r"(?i)\b(?:customer|client|user|talent|data|land|policyholder|member|patient|subscriber)\s+acquisition|\bacquisition\s+(?:cost|kpi|strateg|plan|target|pipeline|spend|marketing|channel|funnel)"
SPECULATIVE = r"(?i)\b(?:eyes?|eyeing|in talks|talks to|could|might|may|would|explor(?:e|es|ing)|rumou?r|mulls?|weighs?|weighing|considers?|considering|nears?|nearing|set to explore|reportedly|is said to|approach(?:es|ed|ing)|bids? for|bidding|interested in|open to|potential|possible|plans? to|looking to|seeks?|seeking|proposed?)\b"
CONSUMER_PURCHASE = r"(?i)\bbuy(?:s|ing)?\s+(?:more\s+|their\s+|a\s+|an\s+)?(?:insurance|polic|cover|protection|annuit)|\binsurance is bought\b|\bbought\s+(?:insurance|polic|cover)"
STOCK_TIP = r"(?i)^\s*\d+\s+\S.*\bto\s+buy\b|\b(?:stocks?|shares?)\s+to\s+buy\b|\bto\s+buy\s+(?:now|amid|before|in\s+20\d\d)\b|\bbuy\s+rating\b|\bzacks\b"
RAISED_TO_BUY = r"(?i)\b(?:rais(?:e|es|ed|ing)|secur(?:e|es|ed)|closes?|lands?|nets?|bags?)\b[^.;:]{0,60}?\bto\s+(?:buy|acquire|fund acquisitions?)\b"
IDIOM_STAKES = r"(?i)\btable stakes\b|\bstakes are high\b|\bhigh[- ]stakes\b"
SHARE_ADMIN = r"(?i)\bshare\s+(?:incentive|buy-?back|repurchase|option|award)|\bbuy-?back\b|\brepurchase\s+program|^\s*REG\s*[-–]"
DEAL_NOISE = [SOFT_ACQUISITION, CONSUMER_PURCHASE, STOCK_TIP, RAISED_TO_BUY, IDIOM_STAKES, SHARE_ADMIN]
MINORITY_STAKE = r"(?i)\bminority\s+(?:stake|investment|interest|position)|\btakes?\s+(?:an?\s+)?equity\s+stakes?\b"
CONTROL_STAKE = r"(?i)\b(?:majority|controlling|control)\s+(?:stake|interest|shareholding|position)|\bstake\s+(?:in|to)\s+\S+\s+to\s+(?:5[1-9]|[6-9]\d|100)%|\bto\s+(?:5[1-9]|[6-9]\d|100)%"
STAKE_PCT = r"(?i)(\d{1,3}(?:\.\d+)?)\s*(?:%|per\s?cent)\s+(?:stake|interest|shareholding|holding)|\bstakes?\s+(?:in|of)\b[^.;]{0,40}?\bto\s+(\d{1,3}(?:\.\d+)?)\s*(?:%|per\s?cent)"
DEAL_HINT = r"(?i)\bacquir|\bacquisition|\bbuys?\b|\bbought\b|\bto buy\b|\bmerge|\bmerger|\btakeover|\btakes? over|\bsnaps? up|\bpicks? up|\bsells?\b|\bsale of\b|\bdivest|\bstake\b|\bpurchase|\bdeal\b"
#: Ordered: pattern, group of the acquirer, of the target, of the seller (0: none). The first valid reading wins.
DEAL_PAIRS = [
    (r"(?i)^(.+?)\s+(?:is\s+|to\s+be\s+|has\s+been\s+)?acquired\s+by\s+(.+)$", 2, 1, 0),
    (r"(?i)^(.+?)\s+sells\s+(.+?)\s+to\s+(.+)$", 3, 2, 1),
    (r"(?i)^(.+?)\s+to\s+(?:acquire|buy|purchase|take\s+over)\s+(.+)$", 1, 2, 0),
    (r"(?i)^(.+?)(?:'s|’s)?\s+(?:completes?d?|announces?d?|finalis|closes?d?)?\s*(?:the\s+)?acquisition\s+of\s+(.+)$", 1, 2, 0),
    (r"(?i)^(.+?)\s+(?:has\s+|have\s+)?(?:acquires?|acquired|buys|bought|snaps?\s+up|picks?\s+up|takes?\s+over|absorbs?)\s+(.+)$", 1, 2, 0),
]
#: In lower case, for each of them: sets of words, of each of which its pattern needs one.
DEAL_PAIR_MARKS = [[["acquired"], ["by"]], [["sells"], ["to"]], [["acquire", "buy", "purchase", "take"], ["to"]], [["acquisition"], ["of"]], [["acquire", "buys", "bought", "snap", "pick", "take", "absorb"]]]
#: The look-ahead for the name keeps its case: a descriptor ends where a capital or a digit begins.
TARGET_PREFIX = r"^(?i:(?:the\s+)?(?:(?:uk|us|u\.s\.|british|american|german|french|dutch|spanish|italian|swiss|indian|singapore(?:an)?|thai|australian|canadian|japanese|irish|nordic|european|asian|african|london|new york|[a-z]+)[- ]based\s+)?(?:ai[- ](?:powered|driven|native)\s+|digital\s+|embedded\s+|specialist\s+|leading\s+|fellow\s+|rival\s+|real[- ]estate\s+|health(?:care)?\s+|life\s+|auto\s+|pet\s+|cyber\s+|travel\s+|commercial\s+)*(?:insurtech|insure?tech|insurance\s+tech(?:nology)?|insurance|insurer|broker(?:age)?|mga|tpa|adjuster|platform|startup|start-up|firm|company|group|provider|specialist|business|arm|unit|division|software|saas)\s+)(?:(?i:firm|company|group|provider|startup|platform)\s+)?(?=[A-Z0-9])"
TARGET_TAIL = r"(?i)\s+(?:to\s+(?:expand|strengthen|grow|build|boost|add|accelerate|create|enhance|scale|bolster|extend|deepen|drive|support|form|launch|enter|target|serve|offer|improve|advance|broaden|complete|further|power)|for\s+(?:[$€£₹¥]|\d|an?\s|about|around|nearly|roughly|over|up\s+to)|in\s+(?:an?\s+)?[$€£₹¥\d][^,;]*?\bdeal\b|in\s+(?:an?\s+)?(?:all-cash|cash|stock|cash-and-stock)\b|amid\b|as\s+it\b|after\b|following\b|despite\b|while\b|which\b|that\b|and\s+(?:series|announces|names|appoints|launches|raises)\b|By\s+[A-Z])(?s:.*)$"
CHAIN_CUT = r"[;:—–]|\s+\|\s+|\s+-\s+(?=[A-Z])"
CLAUSE_VERB = r"(?i)\b(?:expands?|announces?|completes?|strengthens?|moves?|wants?|adds?|grows?|boosts?|launches?|enters?|reveals?|confirms?|eyes?|plans?|sets?|makes?|gets?|sees?|says?|reports?|extends?|deepens?|backs?|names?|appoints?|unveils?|marks?|targets?|accelerates?|bolsters?|broadens?|drives?|builds?|creates?|opens?|returns?|continues?|explores?)\b"
DEAL_TYPES = [("Merger", r"(?i)\bmerg(?:e[sr]?|ing)\b"), ("Majority stake", r"(?i)\b(?:majority|controlling|control)\s+(?:stake|interest|shareholding)"), ("Asset purchase", r"(?i)\b(?:portfolio|book of business|renewal rights|assets|platform|business unit)\b")]
DEAL_TYPE_MARKS = [["merg"], ["majority", "control"], ["portfolio", "book of business", "renewal rights", "assets", "platform", "business unit"]]
PARTY_NOISE = r"\b(?:the|and|group|holdings?|international|subsidiary|company|corp|inc|ltd|limited|plc|llc|sa|ag|gmbh|nv|bv|pte|pty)\b"
TARGET_NOISE = "insurance insurer insurers insurtech insuretech tech technology technologies broker brokers brokerage agency agencies group holdings platform solutions services business businesses firm company digital specialist based north south east west american canadian british european five its assets portfolio unit division arm".split()

# ---- Fixed values: stop lists for headline comparison ----
THREAD_STOP = "the a an and or for to of in on at with from by is are as it its their new this that has have will its than into over amid insurtech insurance tech technology company companies firm firms report reports says announce announces announced launch launches market markets size share growth trends analysis forecast industry global outlook segment segments revenue statistics".split()
ROUND_STOP = "insurtech insurance fintech funding fund raises raise raised round rounds series million billion invest investment investor capital startup startups secures secured lands bags closes closed announces announced announce venture preseed seed extends extension backs backed valuation firm company".split()

# ---- Fixed values: outlets that lift or lower a story ----
REPUTABLE = ["Reuters", "Bloomberg", "Financial Times", "CNBC", "Forbes", "TechCrunch", "The Verge", "Insurance Journal", "Finextra", "Insurance Business", "Reinsurance News", "Artemis", "Coverager", "FinTech Global", "Digital Insurance", "Insurance Times", "Canadian Underwriter", "Life Insurance International", "Insurance Asia", "Beinsure", "The Insurer", "theinsurer.com", "Insurance Edge", "Insurance Nerds", "Program Business", "Carrier Management"]
LOW_SIGNAL = ["EIN Presswire", "PR Newswire", "Business Wire", "GlobeNewswire", "Globe Newswire", "PRWeb", "Yahoo Finance", "Yahoo Finance Singapore", "MSN", "Stock Titan", "Quiver Quantitative", "Market Data Forecast", "Fortune Business Insights", "simplywall.st", "TradingView", "Moomoo", "Pluang", "marketscreener.com", "Zawya", "EIN News", "Centurion Jewelry Show"]
SIGNALS = [(r"(?i)\$\s?\d+(\.\d+)?\s?(k|m|bn|million|billion)\b|series\s+[b-e]\b", 0.6), (r"(?i)acqui|merger|buyout|takeover", 0.5), (r"(?i)launch|unveil|partner|raises?\b", 0.2)]

# ---- Fixed values: company names ----
LEGAL_SUFFIXES = "inc incorporated llc ltd limited corp corporation plc co gmbh nv sa se ag".split()
COMPANY_TYPE = "insurance insurtech insurtechs insurer insurers reinsurance reinsurer fintech insuretech technology technologies tech solutions systems ventures partners capital group holdings holding labs financial services software platform platforms data health life re".split()
INVESTOR_LEAD = r"(?i)\b(?:led by|backed by|funded by|investment from|funding from|participation from|investors?:?)\s+"
LEAD_STOP = "To As For In On At With And After Amid That Its The A An From Over Into While Which Following Bringing Ahead Aiming Backed".split()

# ---- Fixed values: words that tell company names in headlines from what stands around them ----
#: Words that are no company by themselves.
GENERIC_WORDS = """insurance insurer insurers insurtech insurtechs reinsurance reinsurer reinsurers fintech insuretech technology tech
technologies digital ai ml platform platforms group holdings holding market markets report reports research series update updates news
daily business industry sector solution solutions company companies startup startups firm firms ceo cfo cto coo chief star million
billion trillion crore funding fund deal deals round rounds valuation investment investors embedded cyber claims underwriting health
life auto motor property casualty launch partnership partnerships venture ventures capital finance financial services service data
software systems labs app apps program programme profitability capabilities acquisition mou os subsidiary""".split()
#: Words that end a name: grammar, actions, places, modifiers.
GRAMMAR_WORDS = """to for with and or in on at of by as from into over under after before amid via vs than then but so up out off down
through across against about who what which where when why how the a an this that these those its it their his her more most amid
despite following also now over""".split()
ACTION_WORDS = """raises raise raised raising secures secure secured securing lands land landed bags bag bagged closes close closed
closing nabs snags launches launch launched launching unveils unveil unveiled debuts debut introduces introduce introduced acquires
acquire acquired acquiring buys buy bought buying partners partner partnered teams team taps tap tapped selects select selected names
name named naming appoints appoint appointed hires hire hired expands expand expanded picks pick picked onboards integrates integrate
wins win won adds add added deploys deploy signs sign signed inks ink scores score rolls backs back backed powers power completes
complete completed providing provides provide signals signal attracts attract extends extend extended announces announce announced
announcing joins join joined wants plans eyes sets set eyeing offering offers offer offered enters enter helping helps help brings
bring targeting targets""".split()
PLACE_WORDS = """us usa uk eu europe european asia asian africa african america americas american latin latam apac emea mena uae india
indian china chinese japan japanese singapore australia australian canada canadian germany german france french spain spanish italy
italian brazil brazilian mexico mexican pakistan pakistani malaysia malaysian indonesia indonesian philippines nigeria nigerian kenya
saudi gulf gcc korea korean vietnam thailand thai north south east west""".split()
MODIFIER_WORDS = """global digital new top best leading major exclusive breaking latest first heres more sector market industry inside
meet introducing amid""".split()
#: Acronyms of the trade that are no companies.
TRADE_ACRONYMS = """roi llm ltl mga aog tdi naaia efgh llc mou api saas kyc kyb esg ipo faq usd eur gbp gdp evs suv ceo cfo cto coo it hr
pr ev ai ml os ui ux crm erp gwp nps arr""".split()
#: Actions whose object is a company.
OBJECT_ACTIONS = "with acquires acquire buys buy taps selects backs by joins".split()
#: Last words that make a run of two words or more a company.
NAME_ENDINGS = """inc incorporated llc ltd limited corp corporation plc co gmbh nv sa se ag re group holdings holding technologies
technology solutions systems ventures partners capital labs""".split()
ADJECTIVE_ENDING = r"(?i)-(?:based|driven|led|backed|focused|owned|founded|native|first)$"

# ---- Fixed values: floors, caps and bands ----
WIRE_CAP, WIRE_DAYS, SAME_RAISE_DAYS, SAME_DEAL_DAYS = 140, 45, 45, 180
SIZE_BANDS = [("Under $10M", 0.0, 10.0), ("$10M to $50M", 10.0, 50.0), ("$50M to $100M", 50.0, 100.0), ("$100M and above", 100.0, float("inf"))]
LADDER_FLOOR, YTD_FLOOR, COMPANY_PAGE_STORIES = 8, 12, 3

# ---- Fixed values: sectors as (slug, subject, direct pattern, head of an enumeration, related label) ----
_ITEM, _SEP = r"[a-z][\w'&-]*(?:\s+[a-z][\w'&-]*)?", r"(?:\s*,\s*(?:and\s+|or\s+)?|\s+and\s+|\s+or\s+)"
#: What may stand between the head of an enumeration and the noun it belongs to.
LIST_TAIL = rf"(?=(?:{_SEP}{_ITEM}){{0,5}}\s*\b(?:insurance|insurer|reinsurance|coverage|cover|policies|policy|lines|underwriting|risks?|products?|book)\b)"
SECTORS = [
    ("health-insurance", "Health insurance", r"\bhealth insur|health plan|health benefit|health cover|health payer|healthcare payer|\bmedicare\b|\bmedicaid\b|\bmedical insur|dental (?:and vision )?insur|employee benefit", r"\bhealth\b", "Health & Life"),
    ("life-and-annuities", "Life insurance", r"(?<!non)(?<!non-)(?<!non )\blife insur|\bannuit|whole life\b|term life\b|\blife[,\s]+(?:and\s+)?non-?\s?life|life and (?:health|pension|savings)|life assurance|funeral (?:cover|insur)|final expense", r"(?<!non)(?<!non-)(?<!non )\blife\b", "Health & Life"),
    ("auto-insurance", "Auto insurance", r"\bauto insur|car insur|motor insur|vehicle insur|telematics|usage-based insur|fleet insur|driver behaviou?r|rideshare insur", r"\b(?:car|motor|auto|vehicle)\b", "Auto & Mobility"),
    ("home-and-property-insurance", "Home and property insurance", r"\bhome(?:owner)?s?'? insur|renters? insur|property insur|landlord insur|household insur|contents insur|home warranty|property[\s-]?(?:and[\s-]?)?casualty|\bP&C\b", r"\b(?:home|homeowners?|renters?|property|contents|landlord)\b", "Property & Cat"),
    ("commercial-insurance", "Commercial insurance", r"\bcommercial insur|small.business insur|business insurance|commercial lines|commercial P&C|\bSMEs?\b|\bSMBs?\b", r"\bcommercial\b", "Industry"),
    ("specialty-insurance", "Specialty insurance", r"\bspecialty (?:insur|lines|risk)|excess and surplus|surplus lines|\bE&S\b", r"\bspecialty\b", "Industry"),
    ("parametric-and-climate-insurance", "Parametric insurance", r"\bparametric|crop insur|climate risk|catastrophe (?:risk|model|insur)|flood insur|wildfire|weather risk|\bnat cat\b", r"\b(?:parametric|flood|crop|catastrophe)\b", "Property & Cat"),
    ("cyber-insurance", "Cyber insurance", r"\bcyber insur|cyber risk|cyber cover|cyber liabilit|cyber-?securit.{0,30}insur", r"\bcyber\b", "Cyber"),
    ("liability-insurance", "Liability insurance", r"\bliabilit(?:y|ies) insur|general liabilit|\bD&O\b|directors and officers|professional indemnit|\bE&O\b|errors and omissions|malpractice", r"\bliability\b", "Industry"),
    ("travel-insurance", "Travel insurance", r"\btravel insur|travel protection|trip (?:cancellation|protection)|travel medical|flight delay (?:cover|insur)", r"\btravel\b", "Embedded"),
    ("pet-insurance", "Pet insurance", r"\bpet insur|pet health (?:plan|cover|insur)|pet healthcare|veterinar", r"\bpet\b", "Product & Launches"),
    ("workers-compensation", "Workers' compensation insurance", r"workers.{0,3}comp", None, "Claims & Underwriting"),
    ("marine-and-aviation-insurance", "Marine and aviation insurance", r"\bmarine (?:insur|cargo|risk)|cargo insur|shipping insur|hull and machinery|aviation insur", r"\b(?:marine|aviation|cargo)\b", "Industry"),
    ("title-insurance", "Title insurance", r"\btitle insur", r"\btitle\b", "Property & Cat"),
]

#: Kinds of companies that market and sector pages leave out.
KINDS_OUTSIDE = ["Other", "Investor"]

# ---- Fixed values: glossary terms as (slug, pattern on the title, related label) ----
TERMS = [
    ("mga", r"(?i)\bMGAs?\b|managing general agent", "Industry"), ("reinsurance", r"(?i)\breinsur", "Property & Cat"), ("parametric-insurance", r"(?i)parametric", "Property & Cat"),
    ("insurance-broker", r"(?i)\bbrokers?\b|brokerage", "Industry"), ("insurance-fraud", r"(?i)\bfraud\b|fraudulent", "Claims & Underwriting"), ("takaful", r"(?i)takaful", "Industry"),
    ("insurance-linked-securities", r"(?i)insurance[- ]linked securit|\bILS\b|\bcat bonds?\b|catastrophe bonds?", "Property & Cat"), ("annuity", r"(?i)\bannuit(?:y|ies)\b", "Health & Life"),
    ("microinsurance", r"(?i)micro-?insurance", "Industry"), ("protection-gap", r"(?i)protection gap|under-?insur", "Industry"), ("excess-and-surplus-lines", r"(?i)excess (?:and|&) surplus|\bE&S\b|surplus lines|non-?admitted", "Industry"),
    ("workers-compensation", r"(?i)workers.{0,2} comp", "Industry"), ("telematics", r"(?i)telematics|usage[- ]based insur|pay[- ]as[- ]you[- ]drive|pay[- ]how[- ]you[- ]drive", "Auto & Mobility"),
    ("bancassurance", r"(?i)bancassurance", "Embedded"), ("premium-finance", r"(?i)premium financ", "Industry"), ("marine-insurance", r"(?i)marine (?:insur|cargo|hull|underwrit)|cargo insur|hull (?:and|&) machinery", "Industry"),
    ("captive-insurance", r"(?i)captive insur|\bcaptives?\b(?!\s+(?:market|audience|customer))", "Industry"), ("crop-insurance", r"(?i)crop insur|agricultur(?:al|e) insur|\bcrop cover", "Property & Cat"),
    ("trade-credit-insurance", r"(?i)trade credit insur|credit insurance", "Industry"), ("directors-and-officers", r"(?i)\bD&O\b|directors and officers", "Industry"),
    ("professional-indemnity", r"(?i)\bE&O\b|errors and omissions|professional indemnity|professional liability", "Industry"), ("title-insurance", r"(?i)title insurance", "Property & Cat"),
    ("third-party-administrator", r"(?i)third[- ]party administrator|\bTPAs?\b", "Health & Life"), ("stop-loss-insurance", r"(?i)stop[- ]loss|self[- ](?:funded|insured) (?:health|plan|employer)|level[- ]funded", "Health & Life"),
    ("fronting-carrier", r"(?i)\bfronting\b|\bfronted (?:paper|program)", "Industry"), ("surety-bond", r"(?i)\bsurety\b", "Industry"),
    ("extended-warranty", r"(?i)extended warrant|warranty (?:insur|provider|program|cover)", "Embedded"), ("gap-insurance", r"(?i)\bGAP insurance\b|guaranteed asset protection", "Auto & Mobility"),
]

# ---- Fixed values: places ----
NO_COUNTRY = ["global", "worldwide", "international", "remote", "various", "multiple", "europe", "asia", "africa", "north america", "south america", "latin america", "middle east", "apac", "emea", "n/a", "na", "unknown", "none"]
COUNTRY_ALIASES = {
    "United States": ["usa", "us", "u.s.", "u.s.a.", "united states of america", "america"],
    "United Kingdom": ["uk", "u.k.", "great britain", "britain", "england", "scotland", "wales", "northern ireland"],
    "United Arab Emirates": ["uae", "u.a.e."], "South Korea": ["korea", "republic of korea"], "Ireland": ["republic of ireland"], "Netherlands": ["the netherlands", "holland"],
    "Czech Republic": ["czechia"], "Hong Kong": ["hong kong sar"], "China": ["prc", "people's republic of china"],
}
US_STATES = "Alabama,Alaska,Arizona,Arkansas,California,Colorado,Connecticut,Delaware,Florida,Georgia,Hawaii,Idaho,Illinois,Indiana,Iowa,Kansas,Kentucky,Louisiana,Maine,Maryland,Massachusetts,Michigan,Minnesota,Mississippi,Missouri,Montana,Nebraska,Nevada,New Hampshire,New Jersey,New Mexico,New York,North Carolina,North Dakota,Ohio,Oklahoma,Oregon,Pennsylvania,Rhode Island,South Carolina,South Dakota,Tennessee,Texas,Utah,Vermont,Virginia,Washington,West Virginia,Wisconsin,Wyoming,Washington DC,District of Columbia".split(",")
WITH_ARTICLE = ["United States", "United Kingdom", "United Arab Emirates", "Netherlands", "Philippines", "Czech Republic", "Bahamas", "Maldives"]

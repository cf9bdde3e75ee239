"""Rule tables of the announcement feed: data, evaluated by the builders in columns.py."""

# Subjects, patterns, weights and labels must be these for the results to be right.

DROP_SUBJECTS = [
    "Copy of Newspaper Publication",
    "Trading Window",
    "ESOP/ESOS/ESPS",
    "Monitoring Agency Report",
    "Statement of deviation(s) or variation(s) under Reg. 32",
    "Clarification - Financial Results",
    "Shareholders meeting",
    "Registrar & Share Transfer Agent Update",
    "Forfeiture",
    "Disclosure of material issue",
    "Change in Company Secretary/Compliance Officer",
]

KEEP_SUBJECTS = [
    "Outcome of Board Meeting",
    "Board Meeting Intimation",
    "Bagging/Receiving of orders/contracts",
    "Awarding of order(s)/contract(s)",
    "Acquisition",
    "Amalgamation/Merger",
    "Demerger",
    "Scheme of Arrangement",
    "Scheme of Amalgamation - NCLT Order",
    "Other Restructuring",
    "Diversification/Disinvestment",
    "Sale or disposal",
    "Adoption of new line(s) of business",
    "Qualified Institutional Placement",
    "Rights Issue",
    "Buyback",
    "Public Announcement - Buyback of Shares",
    "Fund Raising - Preferential Issue",
    "Issue of Securities",
    "Allotment of Securities",
    "Options to purchase securities",
    "Conversion",
    "Warrant Conversion",
    "Bonus",
    "Stock split",
    "Utilisation of Funds",
    "Dividend",
    "Record Date",
    "Revised Record date",
    "Public Announcement-Open Offer",
    "Disclosure under SEBI Takeover Regulations",
    "Credit Rating- Revision",
    "Credit Rating- New",
    "Defaults on Payment of Interest/Principal",
    "Giving guarantees/indemnity/ becoming a surety for third party",
    "Commencement of commercial production/operations",
    "Capacity addition",
    "Closure of operations",
    "Disruption of Operations",
    "Strikes/Lockouts/Disturbances",
    "Suspension of Trading",
    "Agreements",
    "Memorandum of Understanding/Agreements",
    "Corporate Insolvency Resolution Process",
    "Resolution Plan (for CIRP companies)",
    "Delisting",
    "Action(s) taken or orders passed",
    "Action(s) initiated or orders passed",
    "Pendency of Litigation(s)/dispute(s) or the outcome impacting the Company",
    "Granting/withdrawal/surrender/cancellation/suspension",
    "Change in Management",
    "Change in Director(s)",
    "Resignation of Director/KMP/SMP",
    "Resignation of Statutory Auditor",
    "Change in Auditors",
    "Appointment",
    "Cessation",
    "Retirement",
    "Demise",
    "Resignation",
    "Press Release",
    "Press Release (Revised)",
    "General Updates",
    "Updates",
    "Monthly Business Updates",
    "News Verification",
    "Rumour Verification - Regulation 30(11)",
    "Spurt in Volume",
    "Price movement",
    "Investor Presentation",
    "Analysts/Institutional Investor Meet/Con. Call Updates",
    "Name Change",
    "Name and Symbol Change",
    "Reply to Clarification- Financial results",
    "Corrigendum",
]

LEGACY_KEEP = [
    "Outcome of Board Meeting",
    "Bagging/Receiving of orders/contracts",
    "Acquisition",
    "Commencement of commercial production/operations",
    "Capacity addition",
    "Press Release",
    "Press Release (Revised)",
    "General Updates",
    "Updates",
    "Scheme of Arrangement",
    "Sale or disposal",
    "Dividend",
    "Change in Management",
    "Appointment",
    "Cessation",
    "Resignation",
]

LEGACY_DROP = [
    "Copy of Newspaper Publication",
    "Trading Window",
    "Disclosure under SEBI Takeover Regulations",
    "Analysts/Institutional Investor Meet/Con. Call Updates",
    "ESOP/ESOS/ESPS",
    "Record Date",
    "Monitoring Agency Report",
    "Statement of deviation(s) or variation(s) under Reg. 32",
    "Clarification - Financial Results",
    "Reply to Clarification- Financial results",
    "Shareholders meeting",
    "Registrar & Share Transfer Agent Update",
    "Investor Presentation",
    "Allotment of Securities",
    "Options to purchase securities",
    "Credit Rating",
    "Action(s) initiated or orders passed",
    "Price movement",
    "Spurt in Volume",
    "Forfeiture",
    "Corporate Insolvency Resolution Process",
    "Disclosure of material issue",
    "Pendency of Litigation(s)/dispute(s) or the outcome impacting the Company",
    "Resignation of Director/KMP/SMP",
    "Change in Director(s)",
    "Change in Company Secretary/Compliance Officer",
    "Allotment",
    "Giving guarantees/indemnity/ becoming a surety for third party",
    "Monthly Business Updates",
]

GENUINE_ORDER_SUBJECTS = ["Bagging/Receiving of orders/contracts", "Awarding of order(s)/contract(s)"]

RECURRING_SUBJECTS = [
    "Trading Window",
    "Record Date",
    "Shareholders meeting",
    "Copy of Newspaper Publication",
    "Monthly Business Updates",
    "Analysts/Institutional Investor Meet/Con. Call Updates",
]

SECTORS = [
    ("defence", r"defence|defense|military|army|navy|air force|DRDO|ISRO|missile|warship|ammunition|radar|satellite|aerospace|ordnance|GRSE|BEL|HAL|BEML|Mazagon|Garden Reach|Premier Explosives|Avantel|Data Patterns"),
    ("railway", r"railway|rail|metro|EMU|coach|locomotive|wagon|RVNL|DFCC|IRFC|Titagarh|Texmaco|Jupiter Wagons|loco|train|track laying|rolling stock|signalling"),
    ("solar_renewables", r"solar|photovoltaic|PV module|wind energy|renewable|BESS|battery storage|green hydrogen|clean energy|EV charging|Waaree|Premier Energies|Acme Solar|Inox Green|Solex|Ujaas Energy"),
    ("power", r"\bpower\b|electricity|transmission|distribution|NTPC|NHPC|SJVN|CESC|Torrent Power|Adani Power|substation|transformer|Voltamp|Apar Industries|KEC|Sterlite Power|POWERGRID"),
    ("infrastructure", r"highway|road|bridge|tunnel|airport|port|waterway|irrigation|canal|dam|flyover|EPC|construction|L&T|Afcons|NCC|KNR|PNC|HG Infra|Ceigall|Dilip Buildcon|Gawar|desilting|sewerage|water supply|Jal Jeevan"),
    ("pharma_healthcare", r"pharma|drug|medicine|ANDA|NDA|USFDA|US FDA|API|generic|biosimilar|clinical trial|WHO prequalification|WHO PQ|hospital|healthcare|diagnostic|Lupin|Cipla|Sun Pharma|Aurobindo|Divi|Laurus|Caplin Point|Anuh Pharma"),
    ("IT_technology", r"\bIT\b|software|digital|cloud|SaaS|AI\b|artificial intelligence|machine learning|cybersecurity|data center|Infosys|TCS|Wipro|HCL|Coforge|Mphasis|Hexaware|R Systems|Newgen|Onward Tech|KPIT|Zensar"),
    ("PSU_government", r"public sector|PSU|CPSE|ministry|government|central government|state government|CPWD|GAIL|Coal India|BHEL|SAIL|NMDC|NLCINDIA|Railtel|MTNL|BEL|HAL|Mazagon|tender|bid award|L1|government contract"),
    ("PLI_manufacturing", r"PLI|Production Linked Incentive|Make in India|Atmanirbhar|semiconductor|electronics manufacturing|mobile phone|EV battery|ACC battery|white goods|medical device"),
    ("capital_goods", r"capital goods|engineering|industrial|machinery|equipment|pump|valve|compressor|Bharat Forge|Thermax|Cummins|Kirloskar|Shanthi Gears|Elecon|BEML|Texmaco|new plant|greenfield|brownfield|capacity expansion|commissioning|CAPEX|capex"),
    ("real_estate", r"real estate|realty|housing|apartment|villa|residential|commercial property|office space|Godrej Properties|Sobha|Prestige|DLF|Oberoi|Brigade|Puravankara|Mahindra Life"),
    ("banking_finance", r"bank|NBFC|microfinance|housing finance|NPA|credit|loan|AUM|deposit|CASA|Manappuram|Muthoot|SBFC|Spandana|Aavas|Home First|Poonawalla|AU Bank|RBL"),
    ("FMCG_consumer", r"FMCG|consumer goods|food|beverage|personal care|retail|brand|Dabur|Marico|Jyothy Labs|Emami|Bajaj Consumer|restaurant|QSR|Sapphire Foods|Devyani"),
]

CATALYSTS = [
    ("order_win", r"order|contract|LOA|letter of award|tender"),
    ("acquisition", r"acquisition|acquire|takeover|stake purchase|merger"),
    ("commissioning", r"commissioning|commercial production|plant.*commission|capacity.*added|new capacity"),
    ("results", r"financial results|quarterly results|audited results|annual results"),
    ("dividend", r"dividend|interim dividend|final dividend"),
    ("management", r"CEO|CFO|MD|Managing Director|Chairman|resignation|appointment"),
    ("regulatory", r"ANDA|FDA|USFDA|WHO PQ|regulatory approval|drug approval|patent"),
]

#: (pattern, factor to crore, digits to round to or none)
MONEY = [
    (r"Rs\.?\s*([\d,\.]+)\s*(?:crore|cr\.?)", 1.0, None),
    (r"Rs\.?\s*([\d,\.]+)\s*(?:lakh|lac)", 0.01, None),
    (r"Rs\.?\s*([\d,\.]+)\s*(?:million|mn)\b", 0.01, 1),
    (r"(?:USD|EUR|GBP)\s*([\d,\.]+)\s*(?:million|mn|m)\b", 8.4, 1),
]

SIZES = [(1000, "mega"), (500, "large"), (100, "medium"), (20, "small")]

POSITIVE = r"highest.ever|record|beat|outperform|surge|jump|soar|strong\s+growth|exceed|above\s+estimate|YoY\s+growth|up\s+\d+%|grew\s+\d+%"
NEGATIVE = r"miss|below\s+estimate|decline|fall|drop|loss|YoY\s+de.?growth|down\s+\d+%|shrink"
GOVERNMENT = r"government|ministry|PSU|public sector|CPSE|Jal Jeevan|PMGSY|NHAI|RVNL|NTPC|NHPC|DRDO|ISRO|defence ministry|state government|L1"
EXPORT = r"export|overseas|international order|Israel|Middle East|Africa|ASEAN|Europe|US order|USD order"
REPEATED = r"\b(update|revised|revision|corrigendum|re-filed|reminder|addendum|amendment|erratum|clarification|reclassif|re-submission|follow.?up)\b"

RESULTS = r"financial\s+results|audited\s+results|quarterly\s+results|annual\s+results|submitted.*financial|financial.*period\s+ended"
C_SUITE = r"Managing Director|Chief Executive|\bMD\b|\bCEO\b|\bCFO\b|Chief Financial|\bCTO\b|Chief Technology|Chairman"
LOW_VALUE = r"trading\s+window|newspaper|IEPF|demat\s+report|KYC|scrutinizer|postal\s+ballot|annual\s+report|100.?days|saksham|reminder\s+letter|non.?applicab|large\s+entity|compliance\s+report|board\s+comments\s+on\s+fine|security\s+cover|physical\s+shares"
HIGH_VALUE = r"order[s]?\s*(received|won|bagged|secured|awarded|bag)|contract[s]?\s*(received|won|bagged|secured|awarded)|commission(ing|ed|s)?|commercial\s+production|government|ministry|defence|defense|tender|bid\s+win|export\s+order|joint\s+venture|collaboration|\bMOU\b|memorandum\s+of\s+understanding|plant\s+(commission|capacity|expansion|launch)|new\s+(plant|facility|unit|product|line)|USFDA|US\s*FDA|\bFDA\b|\bWHO\b|\bANDA\b|\bNDA\b|drug\s+approval|regulatory\s+approval|patent|acquisition|merger|amalgamation|demerger|takeover|spin.?off|buyback|QIP|fund.?rais|stake\s+(acqui|purchas|increas)|letter\s+of\s+(award|intent)|\bLOA\b|strategic\s+(partner|acqui|tie.?up)|subsidiary.*incorporat|new.*market|Rs\.?\s*\d[\d,\.]*\s*(?:crore|cr\.?|billion|lakh)|[Rr]s\.\s*\d"
HIGH_VALUE_LEGACY = HIGH_VALUE + r"|₹\s*\d"
DIVIDEND = r"(?:Rs\.?|[Rr]s\.)\s*([\d\.]+)\s*per\s+(?:equity\s+)?share"

BASE_SCORES = {
    "Bagging/Receiving of orders/contracts": 10,
    "Acquisition": 9,
    "Commencement of commercial production/operations": 9,
    "Scheme of Arrangement": 8,
    "Capacity addition": 8,
    "Outcome of Board Meeting": 6,
    "Sale or disposal": 6,
    "Press Release": 5,
    "Press Release (Revised)": 5,
    "General Updates": 3,
    "Updates": 3,
    "Dividend": 4,
    "Change in Management": 2,
    "Appointment": 2,
    "Cessation": 1,
    "Resignation": 1,
}

THEMES = [
    (r"\bdefence|defense|military\b", "defence"),
    (r"\brailway|rail|metro|train\b", "railway"),
    (r"\bsolar|renewable|wind\s+energy|BESS\b", "solar_renewables"),
    (r"\bpower|electricity|transmission\b", "power"),
    (r"\binfrastructure|EPC|highway|road|bridge\b", "infrastructure"),
    (r"\bpharma|drug|FDA|ANDA|biosimilar\b", "pharma_healthcare"),
    (r"\bsoftware|digital|cloud|SaaS\b", "IT_technology"),
    (r"\bPSU|public\s+sector|government\s+contract\b", "PSU_government"),
    (r"\bPLI|Make\s+in\s+India|semiconductor\b", "PLI_manufacturing"),
    (r"\bcapital\s+goods|engineering|industrial\b", "capital_goods"),
    (r"\breal\s+estate|realty|housing\b", "real_estate"),
    (r"\bbank|NBFC|microfinance|AUM\b", "banking_finance"),
    (r"\bFMCG|consumer\s+goods|beverage\b", "FMCG_consumer"),
]

CSV_HEADERS = {
    "symbol": ["symbol", "scrip code", "scripcode", "security code", "nse symbol"],
    "company": ["company name", "company", "security name", "scrip name", "issuer name"],
    "subject": ["subject", "headline", "category", "announcement type", "purpose"],
    "details": ["details", "description", "body", "announcement", "content"],
    "datetime": ["broadcast date/time", "broadcast date", "date time", "date", "datetime", "submitted date/time", "submission date", "announcement date"],
    "attachment": ["attachment", "pdf", "link", "url", "file"],
}

TIMESTAMPS = ["d-MMM-yyyy H:m:s", "yyyy-M-d H:m:s", "d-MMM-yyyy H:m", "yyyy-M-d H:m", "d/M/yyyy H:m:s", "d/M/yyyy", "yyyy-M-d"]

RERANK = {"keyword": 0.35, "score": 0.25, "recency": 0.15, "diversity": 0.10, "value": 0.15, "days": 7.0}

UNITS = r"(?:Rs\.?|₹|INR|Rupees?)\s*[.,]?\s*in\s*(million|mn|lakh|lakhs?|lacs?|crore|cr\.?)|All\s+amounts\s+are\s+in\s+INR\s+(million|lakh|lacs?|crore)|\([^)]*\bin\s+(million|mn|lakh|lacs?|lakhs?|crore|cr\.?)\b[^)]*\)|(?:Rs\.?|₹|INR)\s+(million|lakh|lacs?|crore)|\bin\s+(lakh|lakhs?|lacs?|crore|cr\.?|million|mn)\b"
LAKH_NUMBER = r"\b\d{1,2},\d{2},\d{3}(?:\.\d+)?\b"
NIL = ["", "-", "--", "—", "Nil", "NIL", "NA", "N/A", "Not Applicable"]

EXTRACTION_TYPES = {
    "Outcome of Board Meeting": "financial_results",
    "Bagging/Receiving of orders/contracts": "order_win",
    "Awarding of order(s)/contract(s)": "order_win",
    "Press Release": "press_release",
    "Press Release (Revised)": "press_release",
    "General Updates": "press_release",
    "Updates": "press_release",
    "Analysts/Institutional Investor Meet/Con. Call Updates": "concall",
    "Acquisition": "acquisition",
    "Amalgamation/Merger": "restructuring",
    "Demerger": "restructuring",
    "Scheme of Arrangement": "restructuring",
    "Scheme of Amalgamation - NCLT Order": "restructuring",
    "Qualified Institutional Placement": "fundraising",
    "Rights Issue": "fundraising",
    "Fund Raising - Preferential Issue": "fundraising",
    "Buyback": "buyback",
    "Public Announcement-Open Offer": "open_offer",
    "Credit Rating- Revision": "credit_rating",
    "Credit Rating- New": "credit_rating",
    "Corporate Insolvency Resolution Process": "cirp",
    "Resolution Plan (for CIRP companies)": "cirp",
    "Investor Presentation": "summary_only",
    "Monthly Business Updates": "summary_only",
    "Capacity addition": "summary_only",
    "Commencement of commercial production/operations": "summary_only",
    "Agreements": "summary_only",
    "Memorandum of Understanding/Agreements": "summary_only",
    "Diversification/Disinvestment": "summary_only",
    "Sale or disposal": "summary_only",
    "Adoption of new line(s) of business": "summary_only",
}

ORDER_WORDS = ["order", "orders", "contract", "contracts", "win", "wins", "bagged", "awarded", "l1", "loa"]
BREAKOUT_WORDS = ["breakout", "breakouts", "hvy", "volume", "surge", "signal", "signals", "move", "momentum", "spike"]
FINANCIAL_WORDS = ["revenue", "profit", "pat", "quarterly", "quarter", "results", "financial", "earnings", "ebitda", "margin", "sales", "income", "eps", "dividend", "annual", "q1", "q2", "q3", "q4", "fy"]
SUBJECT_WORDS = ["acquisition", "merger", "amalgamation", "demerger", "insolvency", "nclt", "cirp", "buyback", "qip", "rights issue", "open offer", "credit rating", "management", "appointment", "appointed", "resignation", "resigned", "director", "ceo", "cfo", "cto", "md", "kmp", "fundraising", "allotment", "preferential", "dividend"]
INJECTION = r"ignore (?:all |any )?(?:previous|prior|above) (?:instructions|prompts)|system prompt|you are now|disregard (?:all|the) (?:previous|above)"
BUYBACK_PRICE = r"maximum\s+(?:buyback\s+)?price[^.]*?(?:Rs\.?|₹)\s*([\d,]+(?:\.\d+)?)"
BUYBACK_METHOD = r"(open\s+market|tender\s+offer)"
RATING = r"(?:rated?|rating|assigned?|reaffirmed?|upgraded?|downgraded?|revised?)[^.]{0,80}?(CRISIL|ICRA|CARE|India\s+Ratings|Brickwork|Acuite)\s+([A-D][A-D+\-]*)"
PREVIOUS_RATING = r"(?:from|previous(?:ly)?|earlier)\s+([A-D][A-D+\-]+)"
RATINGS = ["AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "C", "D"]
STOP_WORDS = ["a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with", "from", "is", "are", "was", "were", "which", "that", "this", "has", "have", "had", "be", "been", "its", "it", "as", "if", "so", "but", "not", "no"]

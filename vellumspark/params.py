"""Default parameters and fixed vocabularies."""

# Names, severities, thresholds and defaults that results depend on.
CHUNK_SIZE, CHUNK_OVERLAP = 1024, 200
TOP_K, POOL, SCORE_THRESHOLD, PREFETCH, RRF_K = 5, 20, 0.50, 50, 60
RERANK_N, RERANK_PAGE_N = 8, 10
PROBE_K, PROBE_KEPT, PROBE_PREFIX, EVIDENCE_CHARS = 6, 3, 120, 12_000
EVIDENCE_CUT, NO_EVIDENCE = "\n\n[... passages truncated for context budget ...]", "(retrieval returned no passages)"
CITED_OVERLAP, KEYWORD_SHARE, ELIGIBLE_QUALITY = 0.8, 0.5, 0.85
RULE_WEIGHT, MODEL_WEIGHT = 0.4, 0.6
SEVERITY_VALUE = {"low": 10, "medium": 35, "high": 65, "critical": 90}
SEVERITY_ORDER = {"low": 1, "medium": 2, "high": 3, "critical": 4}
JUDGE_LEAST = 0.7
CLAUSE_OVERLAP, SUMMARY_OVERLAP, RISK_OVERLAP = 0.25, 0.4, 0.20
MAX_CONTENT, REPEAT_LEAST, REPEAT_SHARE = 10_000_000, 1000, 0.85
GATE = {"clause_f1": 0.70, "clause_recall": 0.65, "clause_precision": 0.65, "judge": 0.70, "pass_rate": 0.80, "hallucinations": 0}
REGRESSION_DROP, JUDGE_DROP = 0.05, 0.1
TREND_DAYS, TIMELINE_DAYS = 7, {"7d": 7, "30d": 30, "90d": 90, "all": 14}
SENTENCE_CHARS, TOKEN_LIMIT, NEAR_DUPLICATE = 2500, 4096, 0.85
BM25_K1, BM25_B = 1.2, 0.75

CORE_CLAUSES = ("confidentiality", "termination", "governing_law", "liability", "dispute_resolution", "indemnification")
PENALTY_CLAUSES = ("confidentiality", "termination", "governing_law", "liability", "dispute_resolution")

# Keywords by clause type, in the order that decides ties.
CLAUSE_KEYWORDS = {
    "signatures": ["signature:", "signed by", "authorized representative", "chief technology officer", "chief operating officer", "chief executive"],
    "term_and_renewal": ["shall automatically renew", "automatic renewal", "successive one-year", "non-renewal notice", "initial term"],
    "payment": ["payment", "invoice", "fee", "price", "compensation", "remuneration", "billing", "payable"],
    "intellectual_property": ["intellectual property", "work made for hire", "background ip", "work product", "irrevocably assigns", "copyright", "patent",
                              "trademark", "proprietary rights", "ip rights"],
    "liability": ["liabilit", "limitation of liability", "cap on liability", "not liable", "no liability", "indirect damages", "consequential damages"],
    "indemnification": ["indemnif", "indemnity", "hold harmless", "defend and indemnify"],
    "confidentiality": ["confidential", "non-disclosure", "nda", "proprietary information", "trade secret"],
    "termination": ["terminat", "expir", "cancell", "cancel ", "end of term", "wind down"],
    "dispute_resolution": ["arbitration", "mediation", "dispute resolution", "adr", "alternative dispute", "tribunal"],
    "governing_law": ["governing law", "governed by", "applicable law", "choice of law", "laws of the state", "laws of"],
    "warranty": ["warrant", "warranty", "representation", "as-is", "as is", "merchantability", "fitness for purpose"],
    "force_majeure": ["force majeure", "act of god", "beyond reasonable control"],
}

# Patterns that results depend on, in Java's syntax.
SECTION = r"(?im)^(section|clause|article|exhibit|schedule|annex)\s+[\dA-Z\.]+[\.\d]*"
CAP_VETO = r"(?i)no\s+cap\s+on\s+(?!liability|damages)|capital|recapture|escape\s+hatch|market\s+cap"
CAP_TRIGGER = (r"(?i)shall\s+not\s+exceed|limited\s+to|not\s+exceed|aggregate\s+(?:liability|damages)|maximum\s+(?:liability|aggregate)"
               r"|liability\s+(?:shall\s+be\s+)?capped|cap\s+(?:on\s+)?(?:liability|damages)|in\s+no\s+event\s+shall"
               r"|total\s+liability\s+(?:shall\s+)?(?:not\s+)?exceed")
FEE_CAP = (r"(?i)(?:fees?|amounts?|payments?|charges?)\s+(?:paid|payable|received)(?:\s+\w+){0,8}\s+"
           r"(\d+|one|two|three|six|twelve|twenty.four)\s*(?:\(\d+\))?\s*(?:calendar\s+)?months?(?:\s+(?:prior|preceding|previous|before))?")
AMOUNT = r"(?:USD?\s*)?\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)\s*([MKBmkb](?:illion)?)?"
NOTICE_NUMBER = (r"(?i)(\d+)\s*(?:\(\d+\))?\s*(?:calendar\s+|business\s+)?days?(?:\s+(?:prior|advance|written|advance\s+written))?\s*"
                 r"(?:written\s+)?notice")
NOTICE_WORD = (r"(?i)(one|two|three|four|five|six|seven|eight|nine|ten|fourteen|fifteen|twenty|thirty|forty|forty.five|sixty|ninety"
               r"|one\s+hundred\s+(?:and\s+)?twenty)(?:\s+\(\d+\))?\s*(?:calendar\s+|business\s+)?days?"
               r"(?:\s+(?:prior|advance|advance\s+written|written))?\s*(?:written\s+)?notice")
WORD_DAYS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "fourteen": 14, "fifteen": 15,
             "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "forty five": 45, "sixty": 60, "ninety": 90, "one hundred and twenty": 120,
             "one hundred twenty": 120}
RENEWAL = (r"(?i)automatically?\s+renew(?:s|ed|ing)?|auto(?:matic)?(?:\s+|-)?renewal|successive\s+(?:one|two|\d+)"
           r"|unless\s+(?:(?:either|a)\s+party|written\s+notice)\s+.*?(?:terminates?|cancel|non-renew)|shall\s+renew\s+automatically"
           r"|renews?\s+(?:automatically|for\s+successive)|(?:initial|one)[- ]year\s+term.*?renew")
RENEWAL_TERM = r"(?i)(?:successive|additional|further)\s+(\d+|one|two|three|six|twelve|twenty.four)?\s*-?\s*(month|year|annual|calendar\s+year)"
LAW = (r"(?:governed\s+by\s+(?:and\s+construed\s+in\s+accordance\s+with\s+)?the\s+(?:laws?\s+of\s+(?:the\s+)?)?([A-Z][A-Za-z\s,]+?)(?:\.|,|\s+without)"
       r"|laws?\s+of\s+(?:the\s+(?:State|Republic|Kingdom|Province|Country)\s+of\s+)?([A-Z][A-Za-z\s]+?)(?:\s+shall\s+govern|\s+governs?|\.|,)"
       r"|applicable\s+law\s*:\s*([A-Z][A-Za-z\s,]+?)(?:\.|,))")
OBLIGOR = r"([A-Z][A-Za-z\s,\.]+?)\s+(?:shall|agrees?\s+to|will|must)\s+(?:defend,?\s+)?(?:indemnify|indemnification|hold\s+harmless)"
OBLIGOR_END = r"(?s)^.*(?:indemnify|indemnification|hold\s+harmless)"
WORD3, WORD4 = r"\b[a-z]{3,}\b", r"\b[a-z]{4,}\b"
MODALS, FOUR_DIGITS = ("must", "shall", "will", "may", "cannot"), r"\d{4}"
KEY_ENTITIES = ((r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0), ('"([^"]+)"', 1), (r"\b[A-Z]{2,}\b", 0))
FACTS = (r"\$[\d,]+(?:\.\d{2})?", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
         r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b")
INJECTION = (
    r"(?i)ignore\s+(previous|all)\s+(instructions?|prompts?|rules?)",
    r"(?i)act\s+as\s+(if\s+)?(you\s+)?(are|can)\s+(a\s+)?different",
    r"(?i)disregard\s+(your\s+)?(system|previous)\s+(instructions?|config)",
    r"(?i)//\s*USER\s*INSTRUCTIONS",
    r"<\|.*\|>",
    r"\{\{\s*.*?\s*\}\}",
    r"(?i)\[INST\]\s*.*?\s*\[/INST\]",
)
#: What a match of each has, in lower case.
INJECTION_HAS = ("ignore", "different", "disregard", "//", "<|", "{{", "[inst]")
OFF_TOPIC = ("recipe", "poem", "code", "python", "javascript", "html", "tell me a joke", "story about", "write a song", "ignore context")
LEGAL_WORDS = ("contract", "legal", "clause", "agreement", "law")
UNSAFE = {
    "Waiver claim": r"(?i)you\s+hereby\s+waive\s+(all\s+)?(your\s+)?rights?",
    "Settlement claim": r"(?i)this\s+contract\s+(is|constitutes)\s+(a\s+)?(\w+\s+)?settlement",
    "Irrevocable agreement": r"(?i)party\s+\w+\s+irrevocably\s+agrees",
    "Voidness claim": r"(?i)this\s+agreement\s+(is\s+)?void\s+((under| pursuant to)\s+)?",
    "Rights grant claim": r"(?i)(party\s+\w+\s+)?hereby\s+(grants?|conveys?|assigns?)\s+.+\s+(all\s+)?rights",
}
PAGE_WORDS = (("first", "1st", "one"), ("second", "2nd", "two"), ("third", "3rd", "three"), ("fourth", "4th", "four"), ("fifth", "5th", "five"),
              ("sixth", "6th", "six"), ("seventh", "7th", "seven"), ("eighth", "8th", "eight"), ("ninth", "9th", "nine"), ("tenth", "10th", "ten"))
PAGE_NUMBERS = (r"\bpage\s+(\d+)\b", r"\bp\.?\s*(\d+)\b", r"\bpg\.?\s*(\d+)\b")
TECH_WORDS = ("software", "saas", "technology", "service", "development", "consulting", "app", "platform")
COMMERCE_WORDS = ("service", "saas", "supply", "vendor", "purchase", "sale", "agreement", "consulting")
RISK_PROBES = {
    "financial": "limitation of liability cap aggregate damages shall not exceed",
    "unfavorable_terms": "termination auto-renewal notice period unilateral modification",
    "ambiguous_language": "reasonable material breach confidential information undefined",
    "data_privacy": "data protection personal data processing GDPR CCPA breach notification",
    "compliance": "regulatory compliance export control sanctions anti-bribery FCPA",
    "operational": "force majeure business continuity disaster recovery SLA uptime",
    "missing_clause": "indemnification liability dispute resolution governing law",
}
# Clause type by annotation category; categories not listed are "other".
CATEGORY_TYPES = {
    "Anti-Assignment": "assignment", "Cap on Liability": "liability", "Competitive Restriction": "non_compete",
    "Customer Data - Confidentiality": "confidentiality", "Data Protection": "data_privacy", "Dispute Resolution": "dispute_resolution",
    "Force Majeure": "force_majeure", "Governing Law": "governing_law", "Indemnification": "indemnification", "Insurance": "insurance",
    "Intellectual Property Assignment": "intellectual_property", "License Grant": "intellectual_property",
    "License Restriction": "intellectual_property", "Liquidated Damages": "liability", "No Modification": "amendment", "Non-Compete": "non_compete",
    "Non-Solicitation": "non_solicitation", "Non-Transferable License": "assignment", "Notice Period to Terminate Renewal": "termination",
    "Notice Period to Terminate": "termination", "Price Restrictions": "payment", "Renewal Term": "auto_renewal",
    "Renewal Term (Auto)": "auto_renewal", "Revenue Sharing": "payment", "Royalty Payment Terms": "payment",
    "Termination for Convenience": "termination", "Termination for Cause": "termination", "Uncapped Liability": "liability",
    "Unlimited Liability": "liability", "Warranty Duration": "warranty", "Warranty Scope": "warranty",
}
# Clause type by the first of these that a question contains.
QUESTION_TYPES = (
    ("termination", "termination"), ("convenience", "termination"), ("breach", "termination"), ("non-compete", "non_compete"),
    ("non compete", "non_compete"), ("non-solicit", "non_solicitation"), ("solicit", "non_solicitation"), ("confiden", "confidentiality"),
    ("non-disclosure", "confidentiality"), ("indemnif", "indemnification"), ("liability", "liability"), ("limitation of liability", "liability"),
    ("intellectual property", "intellectual_property"), ("ip ", "intellectual_property"), ("patent", "intellectual_property"),
    ("copyright", "intellectual_property"), ("source code", "intellectual_property"), ("payment", "payment"), ("price", "payment"),
    ("fee", "payment"), ("govern", "governing_law"), ("jurisdiction", "governing_law"), ("dispute", "dispute_resolution"),
    ("arbitrat", "dispute_resolution"), ("warranty", "warranty"), ("warrant", "warranty"), ("insurance", "insurance"), ("assign", "assignment"),
    ("renewal", "auto_renewal"), ("auto-renew", "auto_renewal"), ("force majeure", "force_majeure"), ("data", "data_privacy"),
    ("privacy", "data_privacy"), ("amendment", "amendment"), ("entire agreement", "entire_agreement"), ("severab", "severability"),
)

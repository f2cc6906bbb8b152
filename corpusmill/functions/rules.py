"""Names, patterns, rewrite rules and limits of the domain, in their order of use."""

from __future__ import annotations

# Acts as written in judgments, as patterns without case.
ACT_PATTERNS = {
    "IPC": r"\bIPC\b|\bIndian Penal Code\b|\bPenal Code,?\s*1860\b",
    "BNS": r"\bBNS\b|\bBharatiya Nyaya Sanhita\b",
    "CrPC": r"\bCr\.?P\.?C\.?\b|\bCode of Criminal Procedure\b",
    "BNSS": r"\bBNSS\b|\bBharatiya Nagarik Suraksha Sanhita\b",
    "Evidence Act": r"\bEvidence Act\b|\bIndian Evidence Act\b",
    "BSA": r"\bBSA\b|\bBharatiya Sakshya Adhiniyam\b",
}

# Acts as written in queries.
ACT_ALIASES = {
    "IPC": ("IPC", "INDIAN PENAL CODE", "PENAL CODE"),
    "BNS": ("BNS", "BHARATIYA NYAYA SANHITA", "NYAYA SANHITA"),
    "CRPC": ("CRPC", "CODE OF CRIMINAL PROCEDURE", "CRIMINAL PROCEDURE CODE"),
    "BNSS": ("BNSS", "BHARATIYA NAGARIK SURAKSHA SANHITA", "NAGARIK SURAKSHA SANHITA"),
    "IEA": ("IEA", "INDIAN EVIDENCE ACT", "EVIDENCE ACT"),
    "BSA": ("BSA", "BHARATIYA SAKSHYA ADHINIYAM", "SAKSHYA ADHINIYAM"),
}

# The act of a section that is named without one.
DEFAULT_ACTS = {"300": "IPC", "302": "IPC", "304": "IPC", "304A": "IPC", "307": "IPC", "376": "IPC", "120A": "IPC", "313": "CRPC", "32": "IEA", "101": "BNS", "103": "BNS", "105": "BNS", "351": "BNSS"}

# One code for every spelling of an act, for joins.
ACT_CODES = {"EVIDENCEACT": "IEA", "EVIDENCE ACT": "IEA"}

# Forms of provisions and their mentions.
DASH = "[-–—]"
PROVISION_EXCEPTION = rf"(?i)(\d+)\s*{DASH}?\s*(?:\(\s*)?exception\s*([ivx0-9]+)"
PROVISION_EXCEPTION_OF = r"(?i)exception\s*([ivx0-9]+)\s*(?:to|of)?\s*(?:s(?:ection)?\.?\s*)?(\d+)"
PROVISION_SUBSECTION = rf"^(\d+)\s*{DASH}?\s*\(\s*([0-9]+)\s*\)$"
PROVISION_LETTER = rf"^(\d+)\s*{DASH}?\s*(?:\(\s*)?([A-Za-z]+)(?:\s*\))?$"
SECTION_MENTION = rf"(?i)\b(?:Sections?|S(?:ec)?\.)\s*(\d+[A-Za-z]*(?:\s*[-–—,]?\s*(?:\([^)]*\)|Part\s+[IVX0-9]+|Exception\s+[IVX0-9]+))?)"
SECTION_EXCEPTION = r"(?i)\bException\s+([IVX0-9]+)\s+(?:to|of)?\s*(?:Sections?|S(?:ec)?\.)\s*(\d+)\b"

ROMAN = {"1": "I", "2": "II", "3": "III", "4": "IV", "5": "V"}
ARABIC = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}

COURTS = {"supreme court of india": "Supreme Court of India", "supreme court": "Supreme Court of India", "sci": "Supreme Court of India", "sc": "Supreme Court of India"}
DEFAULT_COURT = "Supreme Court of India"

# Concepts by the variant of the text they are looked for in.
CHUNK_CONCEPTS = {
    "Murder": r"\bmurder\b",
    "Culpable homicide": r"\bculpable homicide\b",
    "Culpable homicide not amounting to murder": r"\bculpable homicide not amounting to murder\b",
    "Dying declaration": r"\bdying declaration\b",
    "Grave and sudden provocation": r"\bgrave and sudden provocation\b",
    "Sudden fight": r"\bsudden fight\b|\bheat of passion\b",
    "Circumstantial evidence": r"\bcircumstantial evidence\b",
    "Ocular evidence": r"\bocular evidence\b|\beyewitness\b|\beyewitnesses\b",
    "Benefit of doubt": r"\bbenefit of doubt\b",
    "First information report (FIR)": r"\bFIR\b|\bfirst information report\b",
    "Common intention": r"\bcommon intention\b",
    "Acquittal": r"\bacquittal\b|\bacquitted\b",
    "Material contradiction": r"\bmaterial contradiction\b|\bmaterial omissions?\b|\binconsistenc(?:y|ies)\b",
    "Medical evidence": r"\bmedical evidence\b|\bpost[- ]mortem\b|\bdoctor\b|\binjuri(?:es|y)\b|\bbamboo stick\b",
    "Motive": r"\bmotive\b|\black of motive\b|\bno motive\b",
    "Sentence alteration": r"\baltered\b|\balteration\b|\bconverted\b|\blesser offence\b",
}
CASE_CONCEPTS = {
    "Murder": r"\bmurder\b",
    "Culpable homicide": r"\bculpable homicide\b",
    "Culpable homicide not amounting to murder": r"\bculpable homicide not amounting to murder\b",
    "Dying declaration": r"\bdying declaration\b",
    "Grave and sudden provocation": r"\bgrave and sudden provocation\b",
    "Sudden fight": r"\bsudden fight\b",
    "Circumstantial evidence": r"\bcircumstantial evidence\b",
    "Ocular evidence": r"\bocular evidence\b",
    "Benefit of doubt": r"\bbenefit of doubt\b",
    "First information report (FIR)": r"\bFIR\b|\bfirst information report\b",
    "Common intention": r"\bcommon intention\b",
    "Acquittal": r"\bacquittal\b|\bacquitted\b",
    "Material contradiction": r"\bmaterial contradiction\b|\bmaterial omissions?\b",
    "Medical evidence": r"\bmedical evidence\b|\bpost[- ]mortem\b",
}
OFFENCES = {"Murder": r"\bmurder\b", "Culpable homicide": r"\bculpable homicide\b"}
STATUTE_CONCEPTS = {
    "murder": r"\bmurder\b",
    "culpable homicide": r"\bculpable homicide\b",
    "culpable homicide not amounting to murder": r"\bculpable homicide not amounting to murder\b",
    "dying declaration": r"\bdying declaration\b",
    "grave and sudden provocation": r"\bgrave and sudden provocation\b",
    "sudden fight": r"\bsudden fight\b|\bheat of passion\b",
    "circumstantial evidence": r"\bcircumstantial evidence\b",
    "ocular evidence": r"\bocular evidence\b|\beyewitness\b",
    "benefit of doubt": r"\bbenefit of doubt\b",
    "first information report": r"\bFIR\b|\bfirst information report\b",
    "common intention": r"\bcommon intention\b",
    "acquittal": r"\bacquittal\b|\bacquitted\b",
    "material contradiction": r"\bmaterial contradiction\b|\bmaterial omissions?\b",
    "medical evidence": r"\bmedical evidence\b|\bpost[- ]mortem\b|\bdoctor\b",
    "private defence": r"\bprivate defence\b|\bself[- ]defence\b",
    "consent": r"\bconsent\b",
    "dowry death": r"\bdowry death\b",
    "cruelty": r"\bcruelty\b",
    "rape": r"\brape\b",
    "abetment": r"\babetment\b|\babets?\b",
    "criminal conspiracy": r"\bcriminal conspiracy\b",
}

# Sections of investigation procedure, and words of their titles.
PROCEDURAL_IDS = (
    "CrPC:154", "CrPC:155", "CrPC:156", "CrPC:157", "CrPC:158", "CrPC:159", "CrPC:160", "CrPC:161", "CrPC:162", "CrPC:163", "CrPC:164", "CrPC:167",
    "CrPC:168", "CrPC:169", "CrPC:170", "CrPC:172", "CrPC:173", "CrPC:174", "CrPC:175", "CrPC:176", "CrPC:200", "CrPC:202", "CrPC:203", "CrPC:204",
    "BNSS:173", "BNSS:174", "BNSS:175", "BNSS:176", "BNSS:177", "BNSS:178", "BNSS:179", "BNSS:180", "BNSS:181", "BNSS:182", "BNSS:190", "BNSS:191",
    "BNSS:192", "BNSS:193", "BNSS:194", "BNSS:195", "BNSS:220", "BNSS:221", "BNSS:351",
)
PROCEDURAL_TITLES = (
    "report of police officer",
    "examination of witnesses by police",
    "dismissal of complaint",
    "completion of investigation",
    "inquest",
    "inquiry by magistrate",
    "power to examine",
    "recording of confessions",
    "statements to police",
)
CURRENT_ACTS = ("BNS", "BNSS", "BSA")
SUPERSEDED_ACTS = ("IPC", "CrPC", "IEA")

# Repairs of scanned statute text, in order, without case.
SCAN_REPAIRS = (
    (r"\bllustrations?\b", "Illustrations"),
    (r"\borimprisonment\b", "or imprisonment"),
    (r"\beitherdescription\b", "either description"),
    (r"\beachmember\b", "each member"),
    (r"\bfirstassault\b", "first assault"),
    (r"\bsevenvears\b", "seven years"),
    (r"\bWhoeverassaults\b", "Whoever assaults"),
    (r"\bofauthority\b", "of authority"),
    (r"\bwithoutsufficient\b", "without sufficient"),
    (r"\bhewas\b", "he was"),
    (r"\bthefirstassault\b", "the first assault"),
    (r"\bapublic\b", "a public"),
    (r"\bpublicservant\b", "public servant"),
    (r"\bandcauses\b", "and causes"),
    (r"\b goodfaith\b", " good faith"),
    (r"\b duedischarge\b", " due discharge"),
    (r"\boffender’s\b", "offender's"),
)

# Page headers and footers, without case.
PAGE_NOISE = (r"^\[\d{4}\]\s*\d+\s*S\.C\.R\.?.*$", r"^Digital Supreme Court Reports$", r"^Supreme Court Reports$", r"^\d{3,5}\x08?$", r"^\*\s*Author$", r"^\* Author$")

# Headings of a judgment's sections, in order of precedence; the judgment itself comes last.
SECTION_HEADINGS = (
    ("ISSUE FOR CONSIDERATION", "issue_for_consideration"),
    ("HEADNOTES", "headnotes"),
    ("CASE LAW CITED", "case_law_cited"),
    ("LIST OF ACTS", "acts_cited"),
    ("LIST OF KEYWORDS", "keywords"),
    ("CASE ARISING FROM", "case_arising_from"),
    ("APPEARANCES FOR PARTIES", "appearances"),
    ("LIST OF WEBSITES", "websites_cited"),
    ("LIST OF BOOKS", "books_cited"),
    ("LIST OF PERIODICALS", "periodicals_cited"),
)
TOPIC_HEADING = r"^[A-Z][A-Za-z\s–—\-]+(?:–|-|:)"

JUDGMENT_ENDS = ("Result of the case:", "Result of the appeal:", "†Headnotes prepared by:")


# Rewrites that spell provisions of judgments in one way, in order.
JUDGMENT_REWRITES = (
    (r"(?i)\bunder\s+Part\s+I\s+of\s+s(?:ec(?:tion)?)?\.?\s*304\s*(?:of\s*(?:the\s*)?IPC)?\b", "under IPC Section 304, Part I"),
    (r"(?i)\bunder\s+Part\s+II\s+of\s+s(?:ec(?:tion)?)?\.?\s*304\s*(?:of\s*(?:the\s*)?IPC)?\b", "under IPC Section 304, Part II"),
    (r"(?i)\bPart\s+I\s+of\s+(?:Section|s\.)\s*304\s*(?:of\s*(?:the\s*)?IPC)?\b", "IPC Section 304, Part I"),
    (r"(?i)\bPart\s+II\s+of\s+(?:Section|s\.)\s*304\s*(?:of\s*(?:the\s*)?IPC)?\b", "IPC Section 304, Part II"),
    (r"(?i)\b(?:Section|s\.)\s*304\s*(?:\(\s*Part\s*1\s*\)|Part\s*I|Part\s*1|Part-I)\b", "IPC Section 304, Part I"),
    (r"(?i)\b(?:Section|s\.)\s*304\s*(?:\(\s*Part\s*2\s*\)|Part\s*II|Part\s*2|Part-II)\b", "IPC Section 304, Part II"),
    (r"(?i)\b(?:Section|s\.)\s*304\s*(?:\(\s*A\s*\)|-A)\b", "IPC Section 304A"),
    (r"(?i)\b(?:Section|s\.)\s*304A\b", "IPC Section 304A"),
    (r"(?i)\b(?:Section|s\.)\s*304-?B\b", "IPC Section 304B"),
    (r"(?i)\bException\s+1\s+(?:to|of)\s+(?:Section|s\.)\s*300\s*(?:of\s*(?:the\s*)?IPC)?\b", "IPC Section 300 Exception 1"),
    (r"(?i)\b(?:Section|s\.)\s*300\s+Exception\s+1\b", "IPC Section 300 Exception 1"),
    (r"(?i)\bException\s+4\s+(?:to|of)\s+(?:Section|s\.)\s*300\s*(?:of\s*(?:the\s*)?IPC)?\b", "IPC Section 300 Exception 4"),
    (r"(?i)\b(?:Section|s\.)\s*300\s+Exception\s+(?:4|IV)\b", "IPC Section 300 Exception 4"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*302\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 302"),
    (r"(?i)\b(?:s\.|ss\.)\s*302\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 302"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*300\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 300"),
    (r"(?i)\b(?:s\.|ss\.)\s*300\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 300"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*299\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 299"),
    (r"(?i)\b(?:s\.|ss\.)\s*299\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 299"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*301\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 301"),
    (r"(?i)\b(?:s\.|ss\.)\s*301\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 301"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*304\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 304"),
    (r"(?i)\b(?:s\.|ss\.)\s*304\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 304"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*34\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 34"),
    (r"(?i)\b(?:s\.|ss\.)\s*34\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 34"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*201\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 201"),
    (r"(?i)\b(?:s\.|ss\.)\s*201\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 201"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*84\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 84"),
    (r"(?i)\b(?:s\.|ss\.)\s*84\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 84"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*120-?B\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 120B"),
    (r"(?i)\b(?:s\.|ss\.)\s*120-?B\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 120B"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*498-?A\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "under IPC Section 498A"),
    (r"(?i)\b(?:s\.|ss\.)\s*498-?A\b(?:\s*of\s*(?:the\s*)?IPC)?\b", "IPC Section 498A"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*313\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 313"),
    (r"(?i)\b(?:s\.|ss\.)\s*313\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 313"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*161\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 161"),
    (r"(?i)\b(?:s\.|ss\.)\s*161\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 161"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*162\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 162"),
    (r"(?i)\b(?:s\.|ss\.)\s*162\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 162"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*164\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 164"),
    (r"(?i)\b(?:s\.|ss\.)\s*164\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 164"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*173\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 173"),
    (r"(?i)\b(?:s\.|ss\.)\s*173\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 173"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*207\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 207"),
    (r"(?i)\b(?:s\.|ss\.)\s*207\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 207"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*209\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 209"),
    (r"(?i)\b(?:s\.|ss\.)\s*209\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 209"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*230\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 230"),
    (r"(?i)\b(?:s\.|ss\.)\s*230\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 230"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*232\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 232"),
    (r"(?i)\b(?:s\.|ss\.)\s*232\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 232"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*366\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 366"),
    (r"(?i)\b(?:s\.|ss\.)\s*366\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "CrPC Section 366"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*173\s*\(2\)\b(?:\s*of\s*(?:the\s*)?CrPC)?\b", "under CrPC Section 173(2)"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*105\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 105"),
    (r"(?i)\b(?:s\.|ss\.)\s*105\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 105"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*106\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 106"),
    (r"(?i)\b(?:s\.|ss\.)\s*106\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 106"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*165\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 165"),
    (r"(?i)\b(?:s\.|ss\.)\s*165\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 165"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*25\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 25"),
    (r"(?i)\b(?:s\.|ss\.)\s*25\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 25"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*27\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 27"),
    (r"(?i)\b(?:s\.|ss\.)\s*27\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 27"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*114\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 114"),
    (r"(?i)\b(?:s\.|ss\.)\s*114\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 114"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*145\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 145"),
    (r"(?i)\b(?:s\.|ss\.)\s*145\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 145"),
    (r"(?i)\b(?:u/s\.?|u/section)\s*157\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "under Evidence Act Section 157"),
    (r"(?i)\b(?:s\.|ss\.)\s*157\b(?:\s*of\s*(?:the\s*)?Evidence\s+Act)?\b", "Evidence Act Section 157"),
    (r"\bFIR\b", "First Information Report (FIR)"),
)


# Queries with the sections that answer them.
GOLD_QUERIES = (
    ("Q1", "What are the exceptions to murder under Section 300?", ("IPC:300", "BNS:101")),
    ("Q2", "Punishment for murder under Section 302 or BNS 103", ("IPC:302", "BNS:103")),
    ("Q3", "Culpable homicide not amounting to murder under Section 304 or BNS 105", ("IPC:304", "BNS:105")),
    ("Q4", "Procedure for statement examination under CrPC 313 or BNSS 351", ("CRPC:313", "BNSS:351")),
    ("Q5", "Admissibility of confession to police under Section 25 IEA or BSA 23", ("IEA:25", "BSA:23")),
    ("Q6", "Definition of criminal conspiracy under IPC 120A or BNS 61", ("IPC:120A", "BNS:61")),
    ("Q7", "Punishment for rape and definition under IPC 376 or BNS 64", ("IPC:376", "BNS:64")),
    ("Q8", "Causing death by negligence under IPC 304A or BNS 106", ("IPC:304A", "BNS:106")),
    ("Q9", "What happens if someone kills a person under grave and sudden provocation during a sudden fight?", ("IPC:300", "BNS:101", "IPC:304", "BNS:105")),
    ("Q10", "What is the legal procedure for examining the accused person during a criminal trial?", ("CRPC:313", "BNSS:351")),
    ("Q11", "Is a confession made by an accused person to a police officer admissible as evidence in court?", ("IEA:25", "BSA:23")),
    ("Q12", "What is the legal definition when two or more persons agree to commit an illegal act together?", ("IPC:120A", "BNS:61")),
    ("Q13", "What is the punishment for causing the death of a person by a rash or negligent driving act?", ("IPC:304A", "BNS:106")),
)

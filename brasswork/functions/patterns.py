"""Patterns of the three document domains."""

# Regular expressions, in the order in which they are tried. Flags: i ignores case, m makes ^ and $ match at lines.

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NAMED_DATE = r"^([A-Za-z]+)\s+(\d{1,2}),?\s*(\d{4})"
SLASHED_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})"

# Regulatory letters
OFFICE = [r"District Office[:\s]+([^\n]+)", r"([\w\s]+ District(?:\s+Office)?)", r"FDA\s+([\w\s]+District(?:\s+Office)?)", r"(Office of Regulatory Affairs[^\n]*)"]
COMPANY = [
    r"(?:CEO|Chief Executive Officer|President|Vice President|Director|Manager)\n([^\n]+(?:Inc\.|LLC|Corp\.|Solutions|Pharmaceuticals|Manufacturing|Industries|Company|Co\.|Ltd\.)[^\n]*)",
    r"([A-Z][^\n]+(?:Inc\.|LLC|Corp\.|Solutions|Pharmaceuticals|Manufacturing|Industries|Company|Co\.|Ltd\.))",
]
RECIPIENT = r"\*{0,2}Issued to:\*{0,2}\s*\n+\*{0,2}([A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+)\*{0,2}"
ISSUED = r"\*{0,2}Date[:\s*]+\*{0,2}\s*([A-Z][a-z]+ \d{1,2},\s*\d{4}|\d{1,2} [A-Z][a-z]+ \d{4})"
ISSUED_NEAR_TOP = r"([A-Z][a-z]+ \d{1,2},\s*\d{4})"
VIOLATION = r"Violation\s+\d+\s*[—\-–:]+\s*([^\n]+)"
CGMP = r"Current Good Manufacturing Practice|CGMP"
REGULATION = r"21\s+CFR\s+§\s+[\d.]+(?:\([a-z]\))?"
REGULATION_PARTS = r"Title\s+21,\s+Code\s+of\s+Federal\s+Regulations.*?(?:Parts?)\s*([\d, and]+)"
CORRECTIVE = [r"corrective action", r"Corrective Action.*?Required", r"CAPA", r"bring your operations into compliance", r"take prompt action to correct"]
DEADLINE = [r"(?:[Ww]ithin\s+)?(?:\w+\s+)?\((\d+)\)\s+working\s+days", r"[Ww]ithin\s+(\d+)\s+(?:working\s+)?days"]
LOT = r"(?:Lot\s+#[A-Z0-9\-]+\s+\()([^)]+)\)"
DRUG = r"((?:[A-Z][a-z]+\s+){1,4}(?:Capsules|Tablets|Solution|Injection|Cream|Ointment)(?:\s*,\s*\d+\s*mg)?)"
GENERIC_DRUG = r"finished pharmaceuticals|drug product"
GREETING = r"Dear [^\n]+,\s*\n+(.+?)(?:\n\n|\Z)"

# Security advisories
ADVISORY_ID = [r"\b(ICSA-\d{2}-\d{3}-\d{2}[A-Z]?)\b", r"\b(AA\d{2}-\d{3}[A-Z])\b", r"\b(CISA-\d{4}-\d{4})\b", r"Advisory\s+(?:ID|Number)[:\s]+([A-Z0-9\-]+)", r"Alert\s+(?:ID|Code)[:\s]+([A-Z0-9\-]+)"]
TITLE = r"^(?:#\s+|Title[:\s]+)(.+)$"
NOT_TITLE = r"^(Release Date|Published|ICSA|AA\d|CVE|https?://)"
PUBLISHED = [
    r"(?:Release Date|Published|Date)[:\s*]+([A-Z][a-z]+ \d{1,2},?\s*\d{4})",
    r"(?:Release Date|Published|Date)[:\s*]+(\d{1,2}/\d{1,2}/\d{4})",
    r"(?:Release Date|Published|Date)[:\s*]+(\d{4}-\d{2}-\d{2})",
]
PUBLISHED_NEAR_TOP, ISO_DATE = r"([A-Z][a-z]+ \d{1,2},?\s*\d{4})", r"(\d{4}-\d{2}-\d{2})"
LEVEL = r"(?:Severity|Risk Level|Criticality)[:\s]+\*{0,2}(Critical|High|Medium|Low)\b"
CVSS = [r"CVSS(?:\s+v\d)?\s+(?:Base\s+)?Score[:\s]+(\d+\.?\d*)", r"(?:Base\s+)?Score[:\s]+(\d+\.?\d*)\s*/\s*10"]
CRITICAL, HIGH_RISK = r"\bcritical\b", r"\bhigh\s+(?:severity|risk|impact)\b"
NO_FIX = [
    r"no\s+(?:known\s+)?(?:patch|fix|mitigation|workaround)\s+(?:is\s+)?(?:available|exists)",
    r"no\s+known\s+\w+\s+(?:or\s+\w+\s+)?(?:is\s+)?(?:available|exists)",
    r"(?:patch|fix|mitigation)\s+(?:is\s+)?not\s+(?:yet\s+)?available",
]
FIX = [
    r"patch(?:es)?\s+(?:are\s+)?available", r"update(?:s)?\s+(?:are\s+)?available", r"mitigation(?:s)?\s+(?:are\s+)?available", r"workaround(?:s)?\s+(?:are\s+)?available",
    r"CISA\s+(?:recommends|urges)\s+users?", r"vendor\s+has\s+(?:released|issued)\s+(?:a\s+)?(?:patch|update|fix|firmware)", r"(?:has\s+)?released\s+(?:firmware|patch|update|fix)",
    r"apply\s+(?:the\s+)?(?:following\s+)?(?:patch|update|mitigation)", r"(?:update|upgrade)\s+(?:to\s+)?(?:firmware|version|v)\s*\w",
]
FIX_SECTION = r"(?:^|[\n#\s])(?:Mitigation|Recommendation|Patch|Remediation)s?\s*[:\n]"
PRODUCTS = r"Affected\s+Products?[:\s]*\n((?:[-•*]?\s*.+\n?){1,20})"
PRODUCTS_INLINE = r"(?:affects?|vulnerable)\s+(?:to\s+)?([A-Z][^\n,;.]{3,50})"
BULLET = r"^[-•*]\s*"
CVE = r"\bCVE-\d{4}-\d{4,7}\b"
REMEDY = r"(?:Mitigation|Recommendation|Patch|Remediation)s?\s*[:\n]\s*\n?((?:.+\n?){1,8})"
EXECUTIVE = r"(?:Executive\s+)?Summary[:\s]*\n((?:.+\n?){1,5})"

# Incident reports
INCIDENT_ID = [r"\b(INC[-_]\d{4}[-_]\d{3,6})\b", r"\b(INC[-_]\d{8}[-_]\d{3,6})\b", r"\b(INC-\d+)\b", r"(?:Incident\s+(?:ID|Number|#|Ticket)[:\s]+)([A-Z0-9\-_]+)", r"(?:Ticket\s+(?:ID|#)[:\s]+)([A-Z0-9\-_]+)", r"(?:Reference[:\s]+)([A-Z]{2,5}-\d{4,8})"]
_OCCURRED = r"(?:Incident\s+Date|Date\s+of\s+(?:Occurrence|Incident)|Occurred|Date\s+Reported)[:\s*]+"
OCCURRED = [_OCCURRED + r"([A-Z][a-z]+ \d{1,2},?\s*\d{4})", _OCCURRED + r"(\d{1,2}/\d{1,2}/\d{4})", _OCCURRED + r"(\d{4}-\d{2}-\d{2})"]
DATED = r"^Date[:\s]+([A-Z][a-z]+ \d{1,2},?\s*\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})"
TYPE = r"(?:Incident\s+Type|Type|Category)[:\s]+([^\n]+)"
TYPE_WORDS = [
    (r"\b(?:service\s+)?outage\b", "Service Outage"), (r"\bsecurity\s+breach\b", "Security Breach"), (r"\bdata\s+(?:loss|breach|leak)\b", "Data Loss"),
    (r"\bperformance\s+degradation\b", "Performance Degradation"), (r"\bnetwork\s+failure\b", "Network Failure"), (r"\bunauthorized\s+access\b", "Unauthorized Access"),
    (r"\bsystem\s+failure\b", "System Failure"), (r"\bdatabase\s+(?:failure|outage|crash)\b", "Database Failure"), (r"\bAPI\s+(?:failure|error|outage)\b", "API Failure"),
]
INCIDENT_LEVEL = r"(?:Severity|Priority\s+Level|Criticality|Impact\s+Level)[:\s]+\*{0,2}(Critical|High|Medium|Low)\b"
PRIORITY, BARE_PRIORITY = r"(?:Priority|Sev|Severity)[:\s]+\*{0,2}P(\d)\b", r"\b(P[1-4])\b"
LEVEL_WORDS = [(r"\bcritical\b", "Critical"), (r"\bhigh\s+(?:severity|priority|impact)\b", "High"), (r"\bmedium\s+(?:severity|priority|impact)\b", "Medium"), (r"\blow\s+(?:severity|priority|impact)\b", "Low")]
STATUS = r"(?:Status|Resolution\s+Status|Incident\s+Status)[:\s]+\*{0,2}(open|resolved|closed|under\s*review|in\s*progress|investigating)\b"
STATUS_WORDS = [(r"\b(?:resolved|closed|mitigated|fixed)\b", "resolved"), (r"\bunder\s+(?:review|investigation)\b", "under_review"), (r"\b(?:open|ongoing|active|investigating|in\s+progress)\b", "open")]
SYSTEMS = r"(?:Affected\s+(?:Systems?|Services?|Components?)|Impacted\s+(?:Systems?|Services?))[:\s]*\n((?:[-•*]?\s*.+\n?){1,15})"
SYSTEMS_INLINE, SYSTEMS_BREAK = r"(?:affected|impacted)\s+(?:system[s]?|service[s]?)[:]\s*([^\n.]+)", r",\s*(?:and\s+)?"
CAUSE = r"(?:Root\s+Cause(?:\s+Analysis)?|RCA)[:\s]*\n?((?:.+\n?){1,8})"
RESOLUTION = r"(?:Resolution|Remediation|Mitigation|Fix|Corrective\s+Action)[:\s]*\n?((?:.+\n?){1,8})"
NEXT_HEADING = r"\n(?:[A-Z][^\n:]{3,40}:)"
REPORTED = [r"(?:Reported\s+by|Filed\s+by|Submitted\s+by|Detected\s+by|Identified\s+by)[:\s]+([^\n]+)", r"(?:Reporter|Author)[:\s]+([^\n]+)"]

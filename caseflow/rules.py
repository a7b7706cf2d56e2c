"""Rule lists: the fixed values that decide what is found in a case text.

Every list is an ordinary tuple of dataclasses and every operator takes its list as a parameter, so a team can pass its
own.  Patterns are written in the ECMAScript regex dialect the values are defined in; ``functions.text.java_regex`` turns
them into the equivalent Java regex for Spark.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A named regular expression.

    ``hints`` are lower-case literals one of which every match contains; texts without any skip the regex.
    ``java`` finds the same matches in linear time on one stack frame, where the pattern would not.
    """

    name: str
    pattern: str
    ignore_case: bool = True
    hints: tuple[str, ...] = ()
    java: str = ""


@dataclass(frozen=True)
class PiiRule:
    """A sensitive category: matches of ``pattern`` become ``[token_1]``, ``[token_2]``, ...

    ``hint`` is a lower-case literal that every match must contain; texts without it skip the regex.
    ``context`` lists words, one of which must lie within 100 characters of the match for it to count.
    ``lead`` is for patterns that begin with a run of characters up to a fixed one: as a Java regex, what may stand between
    the beginning of such a run, or the end of the match before, and the match.  If the first possible start in a run fails,
    so do all others, and without trying them a long run is read once.
    ``around`` is a character without case that every match holds, where neither the match nor what its pattern looks at goes
    beyond a space: of a text, only the stretches between spaces that hold it are searched.
    """

    category: str
    token: str
    pattern: str
    ignore_case: bool = True
    hint: str | None = None
    context: tuple[str, ...] = ()
    lead: str | None = None
    around: str | None = None

    def __post_init__(self):
        if not re.fullmatch(r"\w+", self.token):
            raise ValueError(f"token {self.token!r} must consist of word characters")


# Sensitive-data patterns in the order they apply. Order is part of the result.
PII_RULES = (
    PiiRule("SUBSCRIPTION_ID", "SUB_ID", r"/subscriptions/[a-f0-9-]{36}", hint="/subscriptions/"),
    PiiRule("RESOURCE_GROUP", "RG", r"/resourceGroups/[\w-]+", hint="/resourcegroups/"),
    PiiRule("PROVIDER", "RESOURCE", r"/providers/Microsoft\.[\w/]+", hint="/providers/microsoft."),
    PiiRule("GUID", "GUID", r"\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b", hint="-", around="-"),
    PiiRule("MS_EMAIL", "MS_EMAIL", r"\b[\w-]+@microsoft\.com\b", hint="@microsoft.com",
            lead=r"(?<![\w-])-*+|\G", around="@"),
    PiiRule("EMAIL", "EMAIL", r"\b[\w.-]+@[\w-]+\.[\w.-]+\b", ignore_case=False, hint="@",
            lead=r"(?<![\w.-])[.-]*+|\G", around="@"),
    PiiRule("IP_ADDRESS", "IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ignore_case=False),
    PiiRule("VM_NAME", "VM", r"\bvm-[\w-]+", hint="vm-", around="-"),
    PiiRule("PHONE", "PHONE", r"\b\d{3}-\d{3}-\d{4}\b", ignore_case=False, hint="-", around="-"),
    PiiRule("UNC_PATH", "UNC_PATH", r"\\\\[\w-]+\\[\w\s]+", hint="\\\\"),
    PiiRule("WIN_PATH", "WIN_PATH", r"[A-Z]:\\[\w\\\s.-]+", hint=":\\"),
    PiiRule("REGISTRY", "REGISTRY", r"HKEY_[A-Z_]+\\[\w\\.-]+", hint="hkey_"),
    PiiRule("USER_PATH", "USER_PATH", r"[a-zA-Z]:\\Users\\[^\\\s]+", hint=":\\users\\"),
    PiiRule("DB_SERVER", "DB_SERVER", r"server=[\w.-]+", hint="server="),
    PiiRule("DB_NAME", "DB_NAME", r"database=\w+", hint="database="),
)

# The older pattern pack, same conventions.
PII_RULES_LEGACY = (
    PiiRule("SUBSCRIPTION_ID", "SUB_ID", r"/subscriptions/[a-f0-9-]{36}", hint="/subscriptions/"),
    PiiRule("RESOURCE_GROUP", "RG", r"/resourceGroups/[\w-]+", hint="/resourcegroups/"),
    PiiRule("PROVIDER", "RESOURCE", r"/providers/Microsoft\.[\w/]+", hint="/providers/microsoft."),
    PiiRule("GUID", "GUID", r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", hint="-", around="-"),
    PiiRule("MS_EMAIL", "MS_EMAIL", r"\b[\w-]+@microsoft\.com\b", hint="@microsoft.com",
            lead=r"(?<![\w-])-*+|\G", around="@"),
    PiiRule("EMAIL", "EMAIL", r"\b[\w-]+@[\w-]+\.com\b", hint="@", lead=r"(?<![\w-])-*+|\G", around="@"),
    PiiRule("IP_ADDRESS", "IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ignore_case=False),
    PiiRule("VM_NAME", "VM", r"\bvm-[\w-]+", hint="vm-", around="-"),
    PiiRule("PHONE", "PHONE", r"\b\d{3}-\d{3}-\d{4}\b", ignore_case=False, hint="-", around="-"),
    PiiRule("ID", "ID", r"\b[A-Z]{2,}\d{6,}\b", ignore_case=False),
    PiiRule("UNC_PATH", "UNC_PATH", r"\\\\[\w-]+\\[\w\s]+", hint="\\\\"),
    PiiRule("WIN_PATH", "WIN_PATH", r"[A-Z]:\\[\w\\\s.-]+", hint=":\\"),
    PiiRule("REGISTRY", "REGISTRY", r"HKEY_[A-Z_]+\\[\w\\.-]+", hint="hkey_"),
    PiiRule("WIN_ID", "WIN_ID", r"\b[A-Z]{2}\d{4,}", ignore_case=False),
)

# Second pass of the older pack; a context word must stand near the match where one is listed.
CONTEXT_RULES = (
    PiiRule("PERSON_NAME", "PERSON_NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", ignore_case=False,
            context=("customer", "user", "contact")),
    PiiRule("CUSTOMER_ID", "CUSTOMER_ID", r"\b[A-Z0-9]{8,}\b", ignore_case=False,
            context=("customer", "account", "tenant")),
    PiiRule("USER_PATH", "USER_PATH", r"[a-zA-Z]:\\Users\\[^\\]+", hint=":\\users\\"),
    PiiRule("API_TOKEN", "API_TOKEN", r"\b[A-Za-z0-9]{20,}\b", ignore_case=False,
            context=("key", "token", "secret", "auth")),
    PiiRule("DB_SERVER", "DB_SERVER", r"server=[\w.-]+", hint="server="),
    PiiRule("DB_NAME", "DB_NAME", r"database=\w+", hint="database="),
)

# Fixed value: how far from the match start a context word may lie.
CONTEXT_WINDOW = 100

# The documented alternative pack (whole resource ids, paths, internal aliases).
PII_RULES_EXTENDED = (
    PiiRule("RESOURCE_ID", "RESOURCE_ID", r"/subscriptions/[^/]+/resourceGroups/[^/]+/providers/[^/]+",
            ignore_case=False, hint="/subscriptions/"),
    PiiRule("GUID", "GUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
            ignore_case=False, hint="-", around="-"),
    PiiRule("INTERNAL_ALIAS", "ALIAS", r"[a-zA-Z][a-zA-Z0-9._-]*@(?:microsoft|corp|redmond)\.(?:com|net)",
            ignore_case=False, hint="@", lead=r"(?:(?<![a-zA-Z0-9._-])|\G)[0-9._-]*+", around="@"),
    PiiRule("EMAIL", "EMAIL", r"[\w\.-]+@[\w\.-]+", ignore_case=False, hint="@", lead=r"(?<![\w.-])|\G", around="@"),
    PiiRule("IP_ADDRESS", "IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ignore_case=False),
    PiiRule("CASE_ID", "CASE_ID", r"ICM-\d+|Support-\d+|Incident-\d+", ignore_case=False, hint="-"),
    PiiRule("PATH", "PATH", r"[A-Za-z]:\\[^\s<>:\"|?*]+|/[^\s<>:\"|?*]+", ignore_case=False),
)

# Tags in output order.
TAG_RULES = (
    Rule("AMA", r"\bAMA\b", hints=("ama",)),
    Rule("Windows", r"\bWindows\b", hints=("windows",)),
    Rule("Linux", r"\bLinux\b|\bRedHat\b", hints=("linux", "redhat")),
    Rule("MetricsExtension", r"\bMetricsExtension\b", hints=("metricsextension",)),
    Rule("InfluxDB", r"\bInfluxDb\b", hints=("influxdb",)),
    Rule("Telegraf", r"\bTelegraf\b", hints=("telegraf",)),
    Rule("Timeout", r"\btimeout\b", hints=("timeout",)),
    Rule("Connection", r"\bconnection\b", hints=("connection",)),
    Rule("Azure", r"\bAzure\b", hints=("azure",)),
)

# The older tag list.
TAG_RULES_LEGACY = (*TAG_RULES[:-1], Rule("Version", r"version\s*\d+\.\d+", hints=("version",)))

# Case id patterns; the first pattern that matches anywhere wins.
CASE_ID_RULES = (
    Rule("icm", r"ICM[:-](\d+)", hints=("icm",)),
    Rule("incident", r"Incident[:-](\d+)", hints=("incident",)),
    Rule("support_request", r"Support Request Number:\s*(\d+)", hints=("support request number:",)),
    Rule("support", r"Support[:-](\d+)", hints=("support",)),
)

# Environment fields, group 1 is the value.
ENVIRONMENT_RULES = (
    Rule("subscriptionId", r"Subscription ID[:\s]*([a-f0-9-]{36})", hints=("subscription id",)),
    Rule("workspaceId", r"Workspace ID[:\s]*([a-f0-9-]{36})", hints=("workspace id",)),
    Rule("agentVersion", r"Agent version[:\s]*([0-9.]+)", hints=("agent version",)),
    Rule("osVersion", r"Major OS Version[:\s]*([^:\n]+)", hints=("major os version",)),
)

# Symptom phrases, group 1 is the phrase.
SYMPTOM_RULES = (
    Rule("symptom", r"symptom[s]?[:\s]*([^\n]+)", hints=("symptom",)),
    Rule("issue", r"issue[:\s]*([^\n]+)", hints=("issue",)),
    Rule("problem", r"problem[:\s]*([^\n]+)", hints=("problem",)),
)
MIN_SYMPTOM_LENGTH = 10

# Error lines and the summary line.
ERROR_WORDS = ("Error", "Exception", "Failed")
MAX_ERROR_LINES = 5
SUMMARY_MIN_LENGTH = 20
SUMMARY_SKIP_PREFIX = "---"
SUMMARY_SKIP_TEXT = "ADDITIONAL INFORMATION"
NO_SUMMARY = "No summary found"

# Wider id patterns used on unlabelled text; all matches of each, in this order.
DETECT_ID_RULES = (
    Rule("icm", r"ICM[:-]?\s*(\d{8,12})"),
    Rule("incident", r"Incident[:-]?\s*(\d{8,12})"),
    Rule("support_request", r"(?:Support.*?Request|SR)[:-]?\s*(\d{10,})"),
    Rule("case", r"Case[:-]?\s*(\d{8,})"),
    Rule("product", r"(?:Azure|Office|Teams).*?[:-]?\s*(\d{8,})"),
    Rule("generic", r"\b(?:Case|Ticket|Issue)[:-]?\s*([A-Z0-9]{6,})"),
)

# A text counts as case content if it is long enough and any of these match.
CONTENT_INDICATORS = (
    Rule("record", r"\b(?:ICM|Incident|Support|Case|SR|Ticket)\b"),
    Rule("product", r"\b(?:Azure|Microsoft|Office|Teams)\b"),
    Rule("failure", r"\b(?:Error|Exception|Failed|Timeout)\b"),
    Rule("triage", r"\b(?:Severity|Priority|Status)\b"),
    Rule("party", r"\b(?:Customer|User|Client)\b"),
)
MIN_CONTENT_LENGTH = 50

# Fixed value: discussion entries, group 1 author, group 2 timestamp; "^" is a line start.
DISCUSSION_PATTERN = r"^([A-Za-z\s]+)\n.*?Submitted at ([\d\-:\s]+)"
DISCUSSION_HINT = "Submitted at "
DISCUSSION_TIME = r"^[\d\-:\s]*"

# Volatile parts of a log line, each replaced once per line.
LOG_TIMESTAMP = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}"
LOG_THREAD = r"TID:\d+"
REPEATED_HEADER = "--- COMPRESSED LOG PATTERNS ---"
REPEATED_KEY_CHARS = 100

# Score weight per field, in the order matches are listed.
SEARCH_WEIGHTS = (("summary", 10), ("symptoms", 8), ("errors", 9), ("tags", 5), ("content", 3))

# Sizes of a compact context.
CONTEXT_SYMPTOMS = 3
CONTEXT_ERRORS = 3
LISTED_SYMPTOMS = 2
PREVIEW_CHARS = 500

# Words of a context chunk, least and most, and the least overlap of two chunks.
CHUNK_WORDS = (400, 800)
CHUNK_OVERLAP = 50

# References to linked work items, and small entities in log text.
LINKED_ITEM_PATTERN = r"(?:Work Item|WI|#)\s*(\d{6,})"
ENTITY_RULES = (
    Rule("thread", r"TID:\d+", ignore_case=False),
    Rule("version", r"\b\d+\.\d+(?:\.\d+)*\b", ignore_case=False,
         java=r"(?<!\w)\d++\.\d++(?!\w)(?:\.\d++(?!\w))*+"),
    Rule("timestamp", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?", ignore_case=False),
)

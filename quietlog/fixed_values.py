"""Fixed values.

Everything in this module must keep exactly these values for results to stay
comparable: patterns, word lists, lookup tables, limits and texts. They are
configuration data, stated as plain text in their natural order; no logic lives
here. Patterns are Java regular expressions (see ``functions.text.REGEX_FLAGS``).
"""

# ---- whitespace and line ends ------------------------------------------------
# One whitespace character, Unicode aware, including U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
REPLACEMENT_CHAR = chr(0xFFFD)

# ---- timestamp shapes at the start of a line ----------------------------------
MONTH_NAMES = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
CLOCK = r"\d{2}:\d{2}:\d{2}"
DATE = r"\d{4}-\d{2}-\d{2}"
ISO_ZULU = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z"
COMPACT_DATE_CLOCK = r"\d{6}-\d{2}:\d{2}:\d{2}\.\d+"

# ---- levels -------------------------------------------------------------------
LEVELS_BY_PRIORITY = ["FATAL", "ERROR", "WARN", "INFO", "DEBUG", "TRACE"]
UNKNOWN_LEVEL = "UNKNOWN"
# (text, level): plain substrings, except the padded Info tag which is a pattern.
TAGGED_LEVELS = [
    ("[ERROR:", "ERROR"),
    (r"\[Info\s*\]", "INFO"),
    ("[WARN]", "WARN"),
    ("] ERROR ", "ERROR"),
    ("] INFO ", "INFO"),
    ("] WARN ", "WARN"),
    ("lvl=INFO", "INFO"),
    ("lvl=WARN", "WARN"),
    ("lvl=ERROR", "ERROR"),
    ("lvl=DEBUG", "DEBUG"),
]

# ---- components ---------------------------------------------------------------
UNKNOWN_COMPONENT = "Unknown"
SOURCE_FILE_TAG = r"\[([^\]]*\.(?:cpp|h))[:+]\d+\]"
MODULE_TAG = r"\[mod=([^,\]]+)[,\]]"
ERROR_FILE_TAG = r"\[ERROR:[^/]*([^/]*\.cpp)\(\d+"
PROCESS_TAG = r"WPE\[([^\]]+)\]"
COMPONENT_OF_FILE = {
    "LegacyNetworkAPIs.cpp": "NetworkAPIs",
    "NetworkManagerImplementation.cpp": "NetworkManager",
    "NetworkManagerJsonRpc.cpp": "NetworkManager",
    "NetworkManagerConnectivity.cpp": "NetworkManager",
    "AuthServiceImplementation.cpp": "AuthService",
    "HdmiCecSourceImplementation.cpp": "HdmiCecSource",
    "MaintenanceManager.cpp": "MaintenanceManager",
    "SystemServices.cpp": "SystemServices",
    "DisplaySettings.cpp": "DisplaySettings",
    "RebootController.cpp": "PowerManager",
    "ThermalController.cpp": "ThermalController",
    "ThermalMfrImpl.h": "ThermalController",
    "SecManagerSession.cpp": "SecurityManager",
    "IarmImpl.cpp": "DeviceSettings",
    "CivetWebWSClient.cpp": "WebSocket",
    "LinchPinClient.cpp": "LinchPin",
    "PTimer.cpp": "Timer",
    "helpers.cpp": "Utilities",
    "device_files.cpp": "OCDM",
    "crypto_session.cpp": "OCDM",
    "MediaSession.cpp": "OCDM",
}
COMPONENT_SUFFIXES = [
    "Implementation", "Controller", "Manager", "Service", "Impl", "APIs", "Client", "Session",
]
# (substrings, component), in order of precedence, used when no tag is present.
COMPONENT_OF_MENTION = [
    (["WvCDMi_LOG", "_WvCDM", "MediaKeySession"], "OCDM"),
    (["IARM_event_send", "IARM_Init"], "IARM"),
]
POWER_MENTION = ("PowerManager plugin", "PowerManager")

# ---- default rules ------------------------------------------------------------
RULE_KINDS = [
    "sensitive_patterns",
    "failure_keywords",
    "noisy_log_levels",
    "required_severity_on_failure",
]
SENSITIVE_PATTERNS = [
    r'(?i)"ipaddr"\s*:\s*"(?!127\.0\.0\.1|localhost)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r'(?i)"gateway"\s*:\s*"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r'(?i)"primarydns"\s*:\s*"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r'(?i)"secondarydns"\s*:\s*"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r'(?i)"dhcpserver"\s*:\s*"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r"(?i)\btoken\s*[:=]\s*[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b",
    r"(?i)\b(api[_-]?key|apikey)\s*[:=]\s*[A-Za-z0-9]{20,}\b",
    r'(?i)"requestId"\s*:\s*"[a-f0-9-]{36}"',
    r'(?i)"address"\s*:\s*"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"',
    r"(?i)WPEFramework\[\d+\]",
    r"(?i)PID=\d+.*TID=\d+",
    r"(?i)Device\.[A-Za-z0-9_.]+\s*(?:=|:)",
    r"(?i)\b(password|passwd|pwd)\s*[:=]\s*\S{6,}\b",
    r"(?i)\bauthorization\s*[:=]\s*(bearer|basic)\s+[A-Za-z0-9+/=._-]+\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"-----BEGIN .*PRIVATE KEY-----",
    r'\bhttps?://[^\s";}]+',
    r'(?i)"endpoint"\s*:\s*"[^"]*"',
    r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
    r"(?i)\b[A-Z0-9]{2}[A-Z0-9]{2}[A-Z0-9]{2}[A-Z0-9]{6,}\b",
]
FAILURE_KEYWORDS = [
    "failed", "error", "exception", "invalid", "timeout", "unable to", "could not", "not found",
    "permission denied", "connection refused", "hmac signatures do not match", "unwrap data",
    "secure storage", "usage table", "crypto session", "mediakeysession", "wvcdmi_log error",
    "command not found", "integer expression expected", "unary operator expected",
    "no such file or directory", "is not a child of this shell", "unrecognised", "failurereason",
]
NOISY_LOG_LEVELS = ["DEBUG", "TRACE", "INFO"]
REQUIRED_SEVERITY_ON_FAILURE = ["ERROR", "WARN"]
# Accepted in a rules file; applied on request only.
IGNORE_PATTERNS = [
    "success.*true",
    "heartbeat.*message",
    "timer.*succeeded",
    "response.*success",
    "maintenance.*started",
    "notify.*change",
]
COMPONENT_RULES = {
    "NetworkManager": {
        "frequent_operations": ["getIPSettings", "doPing", "isConnectedToInternet"],
        "acceptable_frequency": 15,
    },
    "MaintenanceManager": {"critical_states": ["MAINTENANCE_ERROR", "MAINTENANCE_FAILED"]},
    "SystemServices": {"warning_events": ["FIRMWARE_UPDATE_STATE", "IARM_BUS_SYSMGR"]},
    "AuthService": {"sensitive_operations": ["GetExperience", "readBytesFromPathParts"]},
    "ThermalController": {"thresholds": {"temperature_warn": 65, "temperature_critical": 80}},
}

# ---- finding texts ------------------------------------------------------------
NOISY, SENSITIVE, SEVERITY = "noisy", "sensitive", "severity"
CATEGORIES = [NOISY, SENSITIVE, SEVERITY]
NOISY_REASON = "Noisy log level: "
SENSITIVE_REASON = "Sensitive / PII data detected"
SEVERITY_REASON = "Failure logged without required severity: "
REDACTED = "[REDACTED]"

# ---- parts of a message that do not count when comparing messages --------------
# Tried in this order at every position, ignoring case; every hit becomes one blank.
VOLATILE_TIMES = [
    r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"[A-Z][a-z]{2}" + SPACE + r"+\d{1,2}" + SPACE + r"+\d{2}:\d{2}:\d{2}",
    r"\d{2}:\d{2}:\d{2}(?:\.\d+)?",
    r"\d{4}-\d{2}-\d{2}",
    r"[A-Z][a-z]{2}" + SPACE + r"+\d{1,2}",
]
VOLATILE_EPOCH = r"\b\d{10,}\.\d+\b:?"
VOLATILE_TASK_IDS = [
    r"tid[:=]?\d+",
    r"pid[:=]?\d+",
    r"thread[:=]?\d+",
    r"\bTID" + SPACE + r"*\d+\b",
    r"\bPID" + SPACE + r"*\d+\b",
]
VOLATILE_LINE_IDS = [r"line[:=]?\d+", r"lineno[:=]?\d+", r"ln[:=]?\d+"]
VOLATILE_NUMBER = r"\b\d{4,6}(?=" + SPACE + r")"
VOLATILE_PROCESS = r"[A-Za-z0-9_\-/]+\[\d+\]"
VOLATILE_TAGS = [
    r"\[[A-Z]{2,5}\]",
    r"\b[A-Za-z0-9_\-]+:",
    r"0x[0-9a-fA-F]+",
    r"\b[0-9a-fA-F]{8,}\b",
    r"\b(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|CRITICAL|FATAL|NOTICE)\b",
]
VOLATILE_PARTS = [
    *VOLATILE_TASK_IDS, *VOLATILE_LINE_IDS, VOLATILE_NUMBER, VOLATILE_PROCESS, *VOLATILE_TAGS,
]

# ---- source limits and names ---------------------------------------------------
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
MAX_MEMBER_BYTES = 8 * 1024 * 1024
MAX_ARCHIVE_CHARS = 200 * 1024 * 1024
UPLOAD_EXTENSIONS = ["txt", "log"]
BINARY_MEMBER_SUFFIXES = [".so", ".pem", ".crt", ".der", ".bin", ".img"]
LOG_MEMBER_NAME = r"(?i)^.*\.(log|txt|out|sh|bak)(\.\d+)?$"
ROTATION_SUFFIX = r"\.\d+$"
ARCHIVE_NAME = r"(?i)\.(tar|tgz|tbz2?|txz|tar\.(gz|bz2|xz))(\.\d+)?$"

# ---- reports -------------------------------------------------------------------
EXAMPLES_PER_GROUP = 5
HISTORY_ROWS_SHOWN = 50
HIGH_ISSUES_ABOVE, MEDIUM_ISSUES_ABOVE = 20, 5
SECTION_TITLES = {
    NOISY: "Noisy Logs",
    SENSITIVE: "Sensitive / PII Logs",
    SEVERITY: "Severity Violations",
}
KNOWN_COLOUR, UNKNOWN_COLOUR = "#0066cc", "#888888"

"""Vendor codes, word lists and patterns the results depend on.

Stated as plain data; nothing here computes.
"""

# --- syslog severity 0..7 -> level -------------------------------------------------
SYSLOG_LEVELS = {
    0: "emergency", 1: "alert", 2: "critical", 3: "error",
    4: "warning", 5: "notice", 6: "info", 7: "debug",
}

# --- FortiGate ---------------------------------------------------------------------
FORTIGATE_LEVELS = {
    "emergency": "emergency", "alert": "alert", "critical": "critical", "error": "error",
    "warning": "warning", "notice": "notice", "information": "info", "info": "info",
    "debug": "debug",
}
# "type/subtype" -> category
FORTIGATE_CATEGORIES = {
    "traffic/forward": "network", "traffic/local": "network", "traffic/sniffer": "network",
    "event/system": "system", "event/user": "auth", "event/admin": "auth",
    "event/vpn": "auth", "event/endpoint": "endpoint",
    "utm/virus": "threat", "utm/webfilter": "threat", "utm/ips": "threat",
    "utm/app-ctrl": "threat",
}
FORTIGATE_ACTIONS = {
    "accept": "allow", "allowed": "allow", "deny": "deny", "blocked": "deny", "drop": "drop",
    "close": "close", "timeout": "timeout", "server-rst": "reset", "client-rst": "reset",
}
FORTIGATE_EXTRA_KEYS = [
    "devname", "devid", "logid", "vd", "policyid", "policytype", "service", "dstcountry",
    "srccountry", "sessionid", "sentbyte", "rcvdbyte", "sentpkt", "rcvdpkt", "duration",
    "subtype", "type",
]
IP_PROTOCOLS = {"6": "tcp", "17": "udp", "1": "icmp", "47": "gre", "50": "esp"}

# --- Cisco: mnemonic -> (category, description, action) ------------------------------
CISCO_MNEMONICS = {
    "302013": ("network", "Built TCP connection", "allow"),
    "302014": ("network", "Teardown TCP connection", "close"),
    "302015": ("network", "Built UDP connection", "allow"),
    "302016": ("network", "Teardown UDP connection", "close"),
    "106001": ("network", "ACL deny (inbound)", "deny"),
    "106006": ("network", "ACL deny (outbound)", "deny"),
    "106007": ("network", "Deny UDP reverse path", "deny"),
    "106014": ("network", "Deny inbound ICMP", "deny"),
    "106023": ("network", "ACL deny (no nat)", "deny"),
    "713172": ("auth", "VPN session event", None),
    "713228": ("auth", "VPN group policy applied", None),
    "722051": ("auth", "AnyConnect session established", "allow"),
    "722052": ("auth", "AnyConnect session terminated", "logoff"),
    "611101": ("auth", "AAA user authentication succeeded", "logon"),
    "611102": ("auth", "AAA user authentication failed", "logon_failed"),
    "611103": ("auth", "AAA user logout", "logoff"),
    "733100": ("threat", "Threat detection drop rate exceeded", None),
    "733101": ("threat", "Threat detection burst rate exceeded", None),
    "400000": ("threat", "IPS alert triggered", None),
}
CISCO_PROTOCOLS = {"302013": "tcp", "302014": "tcp", "302015": "udp", "302016": "udp"}

# --- Windows -------------------------------------------------------------------------
WINDOWS_LEVELS = {0: "info", 1: "critical", 2: "error", 3: "warning", 4: "info", 5: "debug"}
# EventID -> (category, action, message template)
WINDOWS_EVENTS = {
    4624: ("auth", "logon", "Successful account logon: %TargetUserName%"),
    4625: ("auth", "logon_failed",
           "Failed account logon: %TargetUserName% (Logon type %LogonType%)"),
    4634: ("auth", "logoff", "Account logoff: %TargetUserName%"),
    4647: ("auth", "logoff", "User-initiated logoff: %TargetUserName%"),
    4648: ("auth", "logon",
           "Explicit credential logon attempt by %SubjectUserName% as %TargetUserName%"),
    4672: ("auth", "privileged_logon",
           "Special privileges assigned to new logon: %SubjectUserName%"),
    4688: ("endpoint", None, "Process created: %NewProcessName% by %SubjectUserName%"),
    4698: ("endpoint", None, "Scheduled task created: %TaskName%"),
    4702: ("endpoint", None, "Scheduled task updated: %TaskName%"),
    4720: ("auth", None, "User account created: %TargetUserName% by %SubjectUserName%"),
    4722: ("auth", None, "User account enabled: %TargetUserName%"),
    4725: ("auth", None, "User account disabled: %TargetUserName%"),
    4726: ("auth", None, "User account deleted: %TargetUserName% by %SubjectUserName%"),
    4740: ("auth", None, "User account locked out: %TargetUserName%"),
    4756: ("auth", None, "Member added to security-enabled universal group: %MemberName%"),
    4771: ("auth", "logon_failed", "Kerberos pre-authentication failed: %TargetUserName%"),
    4776: ("auth", "logon_failed", "NTLM authentication failure: %TargetUserName%"),
    1102: ("compliance", None, "Audit log was cleared by %SubjectUserName%"),
    7045: ("system", None, "New service installed: %ServiceName% (%ImagePath%)"),
    4697: ("system", None, "Service installed in the system: %ServiceName%"),
}
WINDOWS_LOGON_TYPES = {
    "2": "Interactive", "3": "Network", "4": "Batch", "5": "Service", "7": "Unlock",
    "8": "NetworkCleartext", "9": "NewCredentials", "10": "RemoteInteractive",
    "11": "CachedInteractive",
}
WINDOWS_AUTH_TAG_EVENTS = [4624, 4625, 4648, 4672, 4634, 4647, 4771, 4776]
WINDOWS_CORE_KEYS = [
    "SubjectUserName", "TargetUserName", "IpAddress", "IpPort", "NewProcessName", "ProcessName",
    "LogonType",
]
WINDOWS_LOCAL_ADDRESSES = ["-", "::1", "127.0.0.1"]

# --- Linux ---------------------------------------------------------------------------
LINUX_PROGRAM_CATEGORIES = {
    "sshd": "auth", "sudo": "auth", "su": "auth", "login": "auth", "passwd": "auth",
    "pam": "auth", "useradd": "auth", "userdel": "auth", "groupadd": "auth",
    "kernel": "system", "systemd": "system", "auditd": "compliance", "cron": "system",
    "crond": "system", "rsyslogd": "system",
}
JOURNALD_EXTRA_KEYS = [
    "_SYSTEMD_UNIT", "_BOOT_ID", "SYSLOG_FACILITY", "_UID", "_GID", "_EXE", "_CMDLINE",
    "_TRANSPORT",
]
RSYSLOG_EXTRA_KEYS = ["facility", "app-name", "procid", "msgid", "structured-data"]

# --- compliance ----------------------------------------------------------------------
HIPAA_SESSION_EVENT_IDS = ["4634", "4647"]
WINDOWS_AUDIT_CLEARED = "1102"
FORTIGATE_AUDIT_CLEARED = "0100044546"
RETENTION_YEARS = {"hipaa": 6, "pci_dss": 2}
HOT_STORAGE_MONTHS = 12

# --- operational limits ----------------------------------------------------------------
BLACKLIST_WINDOW_SECONDS = 1800
RATE_LIMIT_PER_SECOND = 10_000.0
RATE_LIMIT_IDLE_SECONDS = 300.0
COOL_AFTER_DAYS, ARCHIVE_AFTER_DAYS, DELETE_AFTER_DAYS = 365, 730, 2192

# --- patterns (Java regular expressions) -------------------------------------------------
KEY_VALUE = r'(\w+)=(?:"([^"]*?)"|(\S+))'
PRIORITY = r"^<(\d+)>"
CISCO_HEADER = r"^(?:<(\d+)>)?(?:(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+)?"
CISCO_TAG = r"(?s)%(?:ASA|PIX|FWSM|FTD)-(\d)-(\w+):\s*(.*)"
IP_PORT = r"(\d{1,3}(?:\.\d{1,3}){3})/(\d+)"
CISCO_USER = r"[Uu]sername\s*[=:]\s*(\S+)"
DETECT_FORTIGATE = r"type=|devname=|logid="
DETECT_CISCO = r"%(?:ASA|PIX|FTD|IOS)-\d-\w+:"
DETECT_WINDOWS = r'"EventID"'
SSH_ACCEPTED = r"Accepted (\S+) for (\S+) from (\S+) port (\d+)"
SSH_FAILED = (
    r"(?:Failed|Invalid user)\s+(?:\S+\s+)?(?:for\s+)?(\S+)?\s+from\s+(\S+)\s+port\s+(\d+)"
)
SSH_DISCONNECTED = r"Disconnected from (?:authenticating\s+)?(?:user\s+)?(\S+)? (\S+) port (\d+)"
SUDO = r"(\S+)\s+:.*USER=(\S+)\s+;\s+COMMAND=(.+)"
PAM = r"(Accepted|Failed|Authentication failure)\s+(?:password\s+)?(?:for\s+)?(?:user\s+)?(\S+)"
AUDITD = r'type=(\w+).*?acct="([^"]+)".*?addr=(\S+)'

# --- time formats --------------------------------------------------------------------------
ISO_FORMATS = ["yyyy-M-d'T'H:m:s.SSSSSS'Z'", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s"]
FORTIGATE_TIME_FORMAT = "yyyy-M-d H:m:s"
BSD_TIME_FORMAT = "yyyy MMM d H:m:s"
# 9999-12-31T23:59:59Z and 0001-01-01T00:00:00Z as epoch seconds
MAX_EPOCH_SECONDS = 253402300799
MIN_EPOCH_SECONDS = -62135596800

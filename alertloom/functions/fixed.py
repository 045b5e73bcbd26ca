"""Constants that decide results, stated once and in natural order."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    pattern: str
    classification: str
    event_type: str
    notify: bool
    extract: tuple
    summary_template: str


# The ordered classification rules; the first match wins.
RULES = [
    Rule("BGP_DOWN", r"%ROUTING-BGP-5-ADJCHANGE.*\bDown\b", "CRITICAL", "BGP Peer Down", True,
         ("neighbor", "as_number", "vrf"), "{device}: BGP peer {neighbor} Down (AS {as_number})"),
    Rule("BGP_MAXPFX", r"%ROUTING-BGP-5-MAXPFX", "CRITICAL", "BGP Max Prefix Reached", True,
         ("neighbor", "prefix_count", "max_prefixes"),
         "{device}: BGP max-prefix on {neighbor} ({prefix_count}/{max_prefixes})"),
    Rule("LACP_EXPIRED", r"%L2-BM-6-ACTIVE.*no longer Active", "CRITICAL",
         "LACP Bundle Member Expired", True, ("interface", "bundle"),
         "{device}: {interface} LACP expired, left {bundle}"),
    Rule("REMOTE_FAULT", r"%PLATFORM-DPA-2-RX_FAULT.*Remote Fault", "CRITICAL",
         "Remote Fault Detected", True, ("interface",), "{device}: Remote Fault on {interface}"),
    Rule("LOCAL_FAULT", r"%PLATFORM-DPA-2-RX_FAULT.*Local Fault", "CRITICAL",
         "Local Fault Detected", True, ("interface",), "{device}: Local Fault on {interface}"),
    Rule("RFI_FAULT", r"-RFI\b.*Detected.*Fault", "CRITICAL", "Fault Detected (RFI)", True,
         ("interface",), "{device}: Fault detected (RFI) on {interface}"),
    Rule("SIGNAL_FAILURE", r"%PLATFORM-VIC-4-SIGNAL.*Signal failure", "CRITICAL",
         "Signal Failure", True, ("interface",), "{device}: Signal failure on {interface}"),
    Rule("SFP_ALARM_SET", r"%PLATFORM-SFP-2-LOW_RX_POWER_ALARM.*\bSet\b", "CRITICAL",
         "SFP Alarm Set", True, ("interface",), "{device}: SFP low-rx-power alarm SET on {interface}"),
    Rule("DUPLICATE_IPV6", r"%IP-IPV6_ND-3-ADDRESS_DUPLICATE", "CRITICAL",
         "Duplicate IPv6 Address", True, ("address", "interface"),
         "{device}: Duplicate IPv6 {address} on {interface}"),
    Rule("INTF_DOWN", r"%PKT_INFRA-LINK-3-UPDOWN.*changed state to Down", "CRITICAL",
         "Interface Down", True, ("interface",), "{device}: {interface} changed state to Down"),
    Rule("LINEPROTO_DOWN", r"%PKT_INFRA-LINEPROTO-5-UPDOWN.*changed state to Down", "CRITICAL",
         "Line Protocol Down", True, ("interface",),
         "{device}: Line protocol on {interface} changed state to Down"),
    Rule("BER_CLEAR", r"%PLATFORM-PLAT_VETHER_DRIVER-3-REPORT_BER_CLEAR", "WARNING", "BER Clear",
         False, ("interface",), "{device}: BER clear on {interface}"),
    Rule("BGP_UP", r"%ROUTING-BGP-5-ADJCHANGE.*\bUp\b", "CRITICAL", "BGP Peer Up", True,
         ("neighbor", "as_number", "vrf"), "{device}: BGP peer {neighbor} Up (AS {as_number})"),
    Rule("INTF_UP", r"%PKT_INFRA-LINK-3-UPDOWN.*changed state to Up", "CRITICAL", "Interface Up",
         True, ("interface",), "{device}: {interface} changed state to Up"),
    Rule("LINEPROTO_UP", r"%PKT_INFRA-LINEPROTO-5-UPDOWN.*changed state to Up", "CRITICAL",
         "Line Protocol Up", True, ("interface",),
         "{device}: Line protocol on {interface} changed state to Up"),
    Rule("SFP_ALARM_CLEAR", r"%PLATFORM-SFP-2-LOW_RX_POWER_ALARM.*\bClear\b", "WARNING",
         "SFP Alarm Clear", False, ("interface",),
         "{device}: SFP low-rx-power alarm CLEARED on {interface}"),
    Rule("LACP_ACTIVE", r"%L2-BM-6-ACTIVE.*(?:is|now) Active", "CRITICAL",
         "LACP Bundle Member Active", True, ("interface", "bundle"),
         "{device}: {interface} Active in {bundle}"),
    Rule("PORT_CREATION_FAIL", r"%PLATFORM-VEEA-3-BCMDPA_L1_PORT_CREATION_FAILURE", "INFO",
         "Port Creation Failure", False, ("interface",),
         "{device}: Port creation failure on {interface} (known LC fault)"),
    Rule("OPERATION_STALLED", r"%PKT_INFRA-GIRO-3-GLOBAL_OPERATION_STALLED", "INFO",
         "Operation Stalled", False, (), "{device}: Global operation stalled (pending retries)"),
    Rule("HW_EVENT_OK", r"%INFRA-SHELF_MGR-6-HW_EVENT.*HW_EVENT_OK", "INFO", "HW Event OK", False,
         (), "{device}: HW_EVENT_OK from shelf manager"),
    Rule("EEM_COMMIT", r"%MGBL-CONFIG-6-DB_COMMIT.*event_manager_user", "INFO",
         "EEM Config Commit", False, (), "{device}: EEM automation config commit"),
    Rule("EEM_SCRIPT", r"%HA-HA_EEM-6-ACTION_SYSLOG_LOG_INFO", "INFO", "EEM Script", False, (),
         "{device}: EEM script action"),
    Rule("NSR_DISABLED", r"%ROUTING-BGP-5-NBR_NSR_DISABLED_STANDBY", "INFO", "NSR Disabled", False,
         ("neighbor",), "{device}: NSR disabled for {neighbor} on standby RP"),
    Rule("SSH_LOGIN", r"%SECURITY-SSHD-6-INFO_SUCCESS", "USER_LOGIN", "SSH Login", False,
         ("user", "source_ip", "vty"), "{device}: SSH login by {user} from {source_ip}"),
    Rule("SSH_LOGOUT", r"%SECURITY-SSHD-6-INFO_USER_LOGOUT", "USER_LOGIN", "SSH Logout", False,
         ("user", "source_ip", "vty"), "{device}: SSH logout by {user} from {source_ip}"),
    Rule("CONFIG_COMMIT_USER", r"%MGBL-CONFIG-6-DB_COMMIT", "USER_LOGIN", "Config Commit by User",
         False, ("user",), "{device}: Config committed by {user}"),
]

# What a line that no rule matches becomes.
UNKNOWN_RULE = Rule("UNKNOWN", "", "INFO", "Unknown Event", False, (), "{device}: {raw}")

# Line limits and the header / timestamp formats.
MAX_LINE_LEN = 8192
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Interface patterns, tried in this order on the message.
_IF_TYPES = "TenGigE|HundredGigE|GigabitEthernet|GigE|Bundle-Ether|FortyGigE|FiftyGigE|TwentyFiveGigE"
INTERFACE_PATTERNS = [
    ("Interface", rf"\bInterface\s+((?:{_IF_TYPES})\S+)"),
    ("Active", rf"\b((?:{_IF_TYPES})\S+)\s+is\s+(?:now\s+|no\s+longer\s+)?Active"),
    ("ifname:", r"\bifname:\s+(\S+)"),
    ("detected", r"\bdetected\s+on\s+(Bundle-Ether\d+)"),
    ("|", r"(?:Set|Clear)\|[^|]*\|[^|]*\|((?:GigE|TenGigE|HundredGigE|GigabitEthernet)\S+)"),
]
NEIGHBOR_PATTERN = r"\bneighbor\s+(\S+)"
AS_PATTERN = r"\(AS[:\s]\s*(\d+)\)"
VRF_PATTERN = r"\(VRF:\s*(\w+)\)"

# The looser patterns used when an alert row lacks the field.
MSG_INTERFACE_PATTERN = (
    r"((?:TwentyFiveGigE|HundredGigE|FiftyGigE|FortyGigE|TenGigE|GigabitEthernet|GigE|Bundle-Ether)[\d/.]+)"
)
MSG_NEIGHBOR_PATTERN = r"(?i)neighbor\s+(\S+)"

# Short interface names, replaced in this order.
INTERFACE_SHORT = [
    ("TwentyFiveGigE", "25GE"),
    ("FiftyGigE", "50GE"),
    ("TenGigE", "TGE"),
    ("HundredGigE", "HGE"),
    ("FortyGigE", "FGE"),
    ("GigabitEthernet", "GE"),
    ("Bundle-Ether", "BE"),
]

# Enumerations.
CLASSES = ["CRITICAL", "WARNING", "INFO", "NOISE", "USER_LOGIN"]
PERIODS = ["today", "yesterday", "7d", "30d", "1y", "all"]
SEVERITY_RANK = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}
RECOVERY_RULES = ["BGP_UP", "INTF_UP", "LINEPROTO_UP", "LACP_ACTIVE", "SFP_ALARM_CLEAR", "BER_CLEAR"]
RECOVERY_UP = ["ADJCHANGE", "UPDOWN"]
RECOVERY_ALWAYS = ["ACTIVE"]
RECOVERY_CLEAR = ["LOW_RX_POWER_ALARM", "TX_POWER_ALARM", "RX_POWER_ALARM", "HIGH_RX_POWER_ALARM"]
HARDWARE_MNEMONICS = ["RX_FAULT", "SIGNAL", "RFI"]
MASS_EVENT_TYPES = ["BGP Peer Down", "BGP Down", "Max Prefix", "BGP Max Prefix Reached"]

# Windows, in seconds.
DEDUP_WINDOW = 300
FLAP_WINDOW = 120
BUNDLE_WINDOW = 60
CORRELATION_WINDOW = 60
FLAP_COUNT_WINDOW = 300
FLAP_THRESHOLD = 3
MASS_THRESHOLD = 3
INCIDENT_TTL = 24 * 3600
RESOLVE_LOOKBACK = 24 * 3600
ESCALATION_DELAY = 900
STALE_AFTER = 600
LOCAL_OFFSET_HOURS = 6

# Shift boundaries as minutes of the day.
SHIFTS = [("morning", 480, 900), ("evening", 900, 1350), ("night", 1350, 480)]

# Columns of the CSV export, in order.
CSV_COLUMNS = ["timestamp", "device", "mnemonic", "classification", "message", "interface",
               "client", "as_name", "incident_id"]

# Message styling.
SEVERITY_COLOR = {"CRITICAL": 0xFF0040, "WARNING": 0xFFD700, "INFO": 0x00D4FF,
                  "USER_LOGIN": 0x00FF88, "NOISE": 0x444466}
SEVERITY_EMOJI = {"CRITICAL": "🔴", "WARNING": "🟡", "INFO": "🔵", "USER_LOGIN": "👤", "NOISE": "⚪"}
ESCALATION_COLOR = 0xFF0000
RESOLUTION_COLOR = 0x00FF88
MAX_FIELD_LEN = 1024
MAX_TEXT_LEN = 4096

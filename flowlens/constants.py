"""Fixed values that results depend on.

Everything in this module is a value that must equal the source system's
for outputs to agree: the public NSL-KDD column layout, the attack-name
taxonomy, the port-to-service table, payload markers and thresholds.
They are listed plainly, in their natural order, and used as data by the
rest of the library.
"""

# ---------------------------------------------------------------------------
# NSL-KDD connection record layout (41 attributes, then the
# label and the difficulty level), in file order.
# ---------------------------------------------------------------------------
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins",
    "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty_level",
]

# The three nominal attributes; all other attributes are numeric.
NOMINAL_COLUMNS = ["protocol_type", "service", "flag"]

LABEL_COLUMN = "label"
DIFFICULTY_COLUMN = "difficulty_level"

# The 41 attributes (no label, no difficulty) and the 38 numeric ones.
ATTRIBUTE_COLUMNS = KDD_COLUMNS[:41]
NUMERIC_COLUMNS = [c for c in ATTRIBUTE_COLUMNS if c not in NOMINAL_COLUMNS]

# ---------------------------------------------------------------------------
# Attack name -> category (40 entries); anything else maps to
# UNKNOWN_CATEGORY.
# ---------------------------------------------------------------------------
ATTACK_CATEGORY = {
    "back": "dos", "land": "dos", "neptune": "dos", "pod": "dos", "smurf": "dos",
    "teardrop": "dos", "apache2": "dos", "mailbomb": "dos", "processtable": "dos",
    "udpstorm": "dos",
    "ipsweep": "probe", "nmap": "probe", "portsweep": "probe", "satan": "probe",
    "mscan": "probe", "saint": "probe",
    "ftp_write": "r2l", "guess_passwd": "r2l", "imap": "r2l", "multihop": "r2l",
    "phf": "r2l", "spy": "r2l", "warezclient": "r2l", "warezmaster": "r2l",
    "sendmail": "r2l", "named": "r2l", "snmpgetattack": "r2l", "snmpguess": "r2l",
    "xlock": "r2l", "xsnoop": "r2l", "worm": "r2l",
    "buffer_overflow": "u2r", "loadmodule": "u2r", "perl": "u2r", "rootkit": "u2r",
    "httptunnel": "u2r", "ps": "u2r", "sqlattack": "u2r", "xterm": "u2r",
    "normal": "normal",
}
UNKNOWN_CATEGORY = "unknown"

# The five trained classes (alphabetical = label-encoder order).
TRAIN_CLASSES = ["dos", "normal", "probe", "r2l", "u2r"]

# ---------------------------------------------------------------------------
# Destination port -> service name; other ports are "other",
# ICMP flows are "eco_i".
# ---------------------------------------------------------------------------
PORT_SERVICE = {
    80: "http", 443: "http_443", 21: "ftp", 22: "ssh", 23: "telnet",
    25: "smtp", 53: "domain_u", 110: "pop_3", 143: "imap4", 3306: "sql_net",
}
DEFAULT_SERVICE = "other"
ICMP_SERVICE = "eco_i"

# Payload markers (matched on the lower-cased payload).
FAILED_LOGIN_MARKERS = ["530 login incorrect", "401 unauthorized", "authentication failure"]
GUEST_LOGIN_MARKERS = ["user anonymous", "guest login"]

# Saturation caps of the window counters.
COUNT_CAP = 511.0
DST_HOST_COUNT_CAP = 255.0

# The agent's capture interval in seconds.
CAPTURE_INTERVAL_SECONDS = 4

# Alerting and dashboard rules.
NORMAL_PREDICTIONS = ["normal", "0"]     # compared lower-cased
HIGH_CONFIDENCE = 0.9                    # strictly greater is the red tier
ALERT_BUFFER_SIZE = 100                  # newest alerts kept by the service
DASHBOARD_ROWS = 51                      # rows left in the newest-first table
ONLINE_SECONDS = 10                      # node age below this is ONLINE
TOP_IMPACTS = 3                          # feature impacts kept per alert
TEST_FRACTION = 0.20
SPLIT_SEED = 42
SELECT_K = 100

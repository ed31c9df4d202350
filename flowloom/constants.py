"""Names and numbers shared by every module.

Everything in this file is a fixed value that has to agree with the public
flow data sets (column names, their order, flag bits) or with the acceptance
rules of the analytics (tolerances, limits, weights).
"""

from __future__ import annotations

# The 77 flow feature columns, in data-set order.
FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length.1",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# Features whose absence or failure counts as critical.
CRITICAL_FEATURES = [
    "Bwd Packet Length Std", "Bwd Packet Length Max", "Avg Bwd Segment Size", "Packet Length Variance",
    "Bwd Packet Length Mean", "Packet Length Std", "Subflow Bwd Bytes", "Total Fwd Packets",
    "Average Packet Size", "Packet Length Mean", "Max Packet Length", "Subflow Fwd Packets",
    "Fwd Header Length.1", "Total Length of Bwd Packets", "Total Backward Packets",
    "Fwd Packet Length Max", "Bwd Packets/s", "Subflow Bwd Packets", "Subflow Fwd Bytes",
    "Fwd Header Length", "Init_Win_bytes_forward", "Bwd Packet Length Min", "Bwd Header Length",
    "Init_Win_bytes_backward", "Avg Fwd Segment Size", "Total Length of Fwd Packets",
    "Fwd IAT Mean", "Fwd IAT Std", "Fwd Packet Length Mean", "Fwd IAT Max",
]

# Identifier columns that never reach a model.
ID_COLUMNS = [
    "Flow ID", "Source IP", "Src IP", "Destination IP", "Dst IP",
    "Source Port", "Src Port", "Destination Port", "Dst Port", "Timestamp", "Protocol",
]
LABEL_COLUMNS = ["Label", "Label_Original", "Label_Binary", "Label_Multiclass"]
# Accepted spellings of the label header, tried in this order.
LABEL_SPELLINGS = ["Label", " Label", "label", "LABEL"]

# TCP flag bits of the `tcp_flags` mask, with the feature each one feeds.
TCP_FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}
FLAG_FEATURES = {
    "FIN Flag Count": "FIN", "SYN Flag Count": "SYN", "RST Flag Count": "RST", "PSH Flag Count": "PSH",
    "ACK Flag Count": "ACK", "URG Flag Count": "URG", "CWE Flag Count": "CWR", "ECE Flag Count": "ECE",
}
TCP, UDP = 6, 17

# Relative tolerance per feature category, and the categories used when
# validating extracted flows against labelled flows. Anything else is "other".
TOLERANCES = {"temporal": 0.30, "count": 0.05, "size": 0.15, "rate": 0.50}
DEFAULT_TOLERANCE = 0.20
VALIDATION_CATEGORIES = {
    "temporal": [
        "Flow Duration", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
        "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
        "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
        "Active Mean", "Active Std", "Active Max", "Active Min",
        "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    ],
    "count": [
        "Total Fwd Packets", "Total Backward Packets", "FIN Flag Count", "SYN Flag Count",
        "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    ],
    "size": [
        "Total Length of Fwd Packets", "Total Length of Bwd Packets",
        "Fwd Packet Length Max", "Fwd Packet Length Mean", "Fwd Packet Length Std",
        "Bwd Packet Length Max", "Bwd Packet Length Mean", "Bwd Packet Length Std",
        "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
        "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    ],
    "rate": ["Flow Bytes/s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s"],
}
# The wider categories used for calibration. Anything else is "default".
CALIBRATION_CATEGORIES = {
    "temporal": VALIDATION_CATEGORIES["temporal"],
    "count": VALIDATION_CATEGORIES["count"] + [
        "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
        "CWE Flag Count", "ECE Flag Count", "Subflow Fwd Packets", "Subflow Bwd Packets", "act_data_pkt_fwd",
    ],
    "size": [
        "Total Length of Fwd Packets", "Total Length of Bwd Packets",
        "Fwd Packet Length Max", "Fwd Packet Length Mean", "Fwd Packet Length Std",
        "Bwd Packet Length Max", "Bwd Packet Length Mean", "Bwd Packet Length Std",
        "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
        "Avg Fwd Segment Size", "Avg Bwd Segment Size",
        "Fwd Packet Length Min", "Bwd Packet Length Min", "Max Packet Length", "Min Packet Length",
        "Fwd Header Length", "Bwd Header Length", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk",
        "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Subflow Fwd Bytes", "Subflow Bwd Bytes",
        "Init_Win_bytes_forward", "Init_Win_bytes_backward", "min_seg_size_forward",
    ],
    "rate": VALIDATION_CATEGORIES["rate"] + ["Down/Up Ratio", "Fwd Avg Bulk Rate", "Bwd Avg Bulk Rate"],
}

# The scorecard.
MAX_FPR, MAX_LATENCY_MS = 0.01, 1.0
F2_WEIGHT, LATENCY_WEIGHT = 0.70, 0.30
MODEL_TYPES = ["random_forest", "xgboost", "lightgbm"]

# The public five-day capture set, one row per labelled file; the last field is a note of our own.
DAYS = [
    ("monday", "Monday-WorkingHours.pcap_ISCX.csv", "Monday-WorkingHours.pcap", [],
     "benign only"),
    ("tuesday", "Tuesday-WorkingHours.pcap_ISCX.csv", "Tuesday-WorkingHours.pcap",
     ["FTP-Patator", "SSH-Patator"], "password guessing over FTP and SSH"),
    ("wednesday", "Wednesday-workingHours.pcap_ISCX.csv", "Wednesday-workingHours.pcap",
     ["DoS slowloris", "DoS Slowhttptest", "DoS Hulk", "DoS GoldenEye", "Heartbleed"],
     "denial of service at the application layer, Heartbleed"),
    ("thursday_morning", "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv", "Thursday-WorkingHours.pcap",
     ["Web Attack - Brute Force", "Web Attack - XSS", "Web Attack - Sql Injection"], "attacks on a web application"),
    ("thursday_afternoon", "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
     "Thursday-WorkingHours.pcap", ["Infiltration"], "intrusion from inside"),
    ("friday_morning", "Friday-WorkingHours-Morning.pcap_ISCX.csv", "Friday-WorkingHours.pcap",
     ["Bot"], "bot traffic"),
    ("friday_afternoon_portscan", "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
     "Friday-WorkingHours.pcap", ["PortScan"], "port scans"),
    ("friday_afternoon_ddos", "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv", "Friday-WorkingHours.pcap",
     ["DDoS"], "distributed denial of service"),
]

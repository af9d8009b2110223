"""Token pattern, blocked and safe words, material spellings."""

TOKEN_PATTERN = "[0-9a-zA-Z가-힣]+"
SEPARATOR_PATTERN = "[^0-9a-zA-Z가-힣]+"
VOCABULARY = 8192
BLOCKED_WORDS = [
    "anomaly", "bad", "chatter", "fault", "good", "label", "labels", "roughness", "surface", "target", "vb", "wear",
]
OPERATION_WORDS = ["cutting", "drilling", "face", "finishing", "milling", "slot", "slotting", "turning"]
MATERIAL_PATTERNS = [
    r"\baisi[_ -]?\d{3,4}\b",
    r"\b(?:al|aa)[_ -]?(?:6061|7075|2024|5083)\b",
    r"\b(?:aluminum|aluminium|steel|titanium|inconel|brass|copper|sus\d*|skd\d*|scm\d*)\b",
]
SAMPLE_PREFIX = "cnc machining sample"
RECORD_KEYS = ["machine_id", "tool_id", "operation_id", "cut_id", "cycle_id"]
REQUEST_FIELDS = [
    ("text_context", "context"), ("tool_info", "tool"), ("material_info", "material"), ("machine_info", "machine"),
    ("operation_info", "operation"), ("process_description", "process"),
]

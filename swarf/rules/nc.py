"""Control-program word patterns, vector layout and matrix scales."""

CONTEXT_DIM = 128
BUCKETS = 32
WORD_PATTERN = r"([A-Z])\s*([+-]?(?:\d+(?:\.\d*)?|\.\d+))"
PROGRAM_PATTERN = r"(?i)\bO\s*(\d{3,6})\b"
AXIS_LETTERS = ["X", "Y", "Z", "A", "B", "C", "I", "J", "K", "R"]
MOTION_LETTERS = ["X", "Y", "Z", "A", "B", "C"]
MODAL_LETTERS = ["G", "M", "S", "F", "T"]
MATRIX_SCALES = {
    "G": 100, "M": 100, "T": 100, "S": 20000, "F": 20000, "X": 1000, "Y": 1000, "Z": 1000, "I": 1000, "J": 1000,
    "K": 1000, "R": 1000, "Q": 1000, "P": 1000,
}
# statistic name, logarithm divisor; None marks the four motion shares
VECTOR_SCALARS = [
    ("block_count", 11.0), ("word_count", 12.0), ("rapid", None), ("linear", None), ("cw_arc", None), ("ccw_arc", None),
    ("cycle_count", 5.0), ("tool_change_count", 5.0), ("coolant_on_count", 5.0), ("spindle_on_count", 5.0),
    ("spindle_stop_count", 5.0), ("optional_stop_count", 5.0), ("absolute_count", 5.0), ("incremental_count", 5.0),
    ("work_offset_count", 5.0), ("tool_count", 4.0), ("feed_min", 9.0), ("feed_max", 9.0), ("feed_mean", 9.0),
    ("spindle_min", 11.0), ("spindle_max", 11.0), ("spindle_mean", 11.0),
]
SPAN_SCALE = 500.0
BUCKET_DIVISOR = 8.0
CODE_DIVISOR = 7.0

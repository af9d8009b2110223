"""File classes, label and condition words, dataset rules."""

FILE_TYPES = [
    ("tabular", [".csv", ".xls", ".xlsx", ".parquet"]),
    ("image", [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif"]),
    ("audio", [".wav", ".au", ".flac", ".mp3", ".aup"]),
    ("numpy", [".npy", ".npz"]),
    ("matlab", [".mat"]),
    ("hdf5", [".h5", ".hdf5"]),
    ("json", [".json", ".jsonl"]),
    ("txt", [".txt", ".md", ".log"]),
    ("binary", [".pt", ".pth", ".bin"]),
]
LABEL_WORDS = [
    ("tool_wear_vb", ["tool_wear", "wear", "vb"]),
    ("rul", ["rul", "remaining_useful_life"]),
    ("wear_state", ["wear_state", "wear_class"]),
    ("chatter", ["chatter"]),
    ("surface_roughness", ["roughness", "surface", "ra"]),
    ("dimension_error", ["dimension", "dim_error"]),
    ("quality_class", ["quality"]),
    ("anomaly_state", ["anomaly", "fault"]),
    ("energy_consumption", ["energy"]),
]
CONDITION_WORDS = [
    ("spindle_speed", ["spindle_speed", "rpm", "speed"]),
    ("feed_rate", ["feed_rate", "feed"]),
    ("depth_of_cut", ["depth_of_cut", "doc", "ap"]),
    ("width_of_cut", ["width_of_cut", "woc", "ae"]),
    ("tool_diameter", ["tool_diameter", "diameter"]),
    ("material", ["material"]),
    ("operation_type", ["operation", "process"]),
    ("machine_id", ["machine_id", "machine"]),
    ("tool_id", ["tool_id", "tool"]),
]
LABEL_TASKS = {
    "tool_wear_vb": "toolwear_regression",
    "rul": "rul_prediction",
    "wear_state": "wear_state_classification",
    "chatter": "chatter_detection",
    "surface_roughness": "surface_roughness_prediction",
    "dimension_error": "quality_prediction",
    "quality_class": "quality_prediction",
    "anomaly_state": "anomaly_detection",
    "energy_consumption": "energy_prediction",
}
FORECASTING_WORDS = ["signal", "sensor", "time", "acc", "force"]
MODALITIES = ["audio", "frequency", "image", "process_condition", "sensor_series"]
RAW_SIGNAL_BYTES = 100_000
FEATURE_ONLY_PATTERN = "feature|statistic|summary|extract"
SYNTHETIC_PATTERN = "synthetic|simulation|simulated|simulink"

# word in dataset or path -> (sampling rate, material, family, source, confidence)
KNOWN_DATASETS = [
    (["t4000"], (12800.0, "aluminum", "nonferrous_metal", "user_defined", "high")),
    (["edge_oti", "edge oti"], (4000.0, "S45C", "carbon_steel", "user_defined", "high")),
]
HIGH_SAMPLING_WORDS = ["vibration", "acceler", "acoustic", "waveform", "hf", "high_frequency"]
CONTROLLER_SERIES_WORDS = ["cnc", "focas", "gcode", "rpm", "feed", "axis", "spindle", "servo"]
FREQUENCY_WORDS = ["fft", "spectrum", "spectral", "frequency"]
TIME_FREQUENCY_WORDS = ["stft", "scalogram", "wavelet", "spectrogram", "time_frequency"]
CONTROLLER_CHANNEL_WORDS = ["rpm", "feed", "position", "load", "servo", "gcode", "tool", "axis", "spindle"]
SUBGRAPH_WORDS = [
    ("spindle_dynamics", ["spindle", "rpm", "chatter"]),
    ("feed_drive", ["axis", "feed", "servo", "position", "current", "load"]),
    ("cutting_condition", ["feedrate", "spindle_speed", "tool", "depth", "width", "material"]),
    ("cnc_operation_state", ["gcode", "focas", "operation", "tool_num", "tool_call"]),
    ("high_frequency_vibration", ["vibration", "acceler", "acoustic", "fft", "spectrum"]),
]
MATERIAL_SUBGRAPH = "material_process_context"
EXPECTED_VARIABLES = [
    "vibration_x", "vibration_y", "vibration_z", "force", "ae", "spindle_speed", "feed_rate", "depth_of_cut",
]
UNPAIRED_PATHS = ["/cnc_data/", "/coordinate_data/", "/metadata/", "/02. machining_data/"]
GROUP_COLUMNS = ["run_id", "tool_id", "machine_id", "material", "condition_id", "site", "dataset_id"]

"""Channel vocabularies, spellings and name rules (schema version ``cnc-v1``)."""

SCHEMA_VERSION = "cnc-v1"

QUANTITIES = [
    "unknown", "vibration", "acoustic_emission", "force", "torque", "current", "voltage", "power", "energy", "load",
    "sound", "temperature", "pressure", "flow", "position", "position_error", "velocity", "speed", "feed_rate",
    "depth_of_cut", "width_of_cut", "tool_diameter", "tool_wear", "surface_roughness",
]
AXES = ["unknown", "none", "x", "y", "z", "u", "v", "w", "a", "b", "c", "radial", "axial", "tangential"] + [
    f"channel_{i}" for i in range(32)
]
SOURCES = ["unknown", "external_sensor", "machine_controller", "process_condition", "derived_feature"]
COMPONENTS = [
    "unknown", "machine", "spindle", "tool", "workpiece", "table", "axis_drive", "motor", "fixture", "coolant", "environment",
]
REPRESENTATIONS = [
    "unknown", "raw", "actual", "command", "setpoint", "rms", "mean", "std", "min", "max", "peak", "peak_to_peak",
    "kurtosis", "skewness", "crest_factor", "spectrum", "energy",
]
ATTRIBUTES = {
    "quantity": QUANTITIES, "axis": AXES, "source": SOURCES, "component": COMPONENTS, "representation": REPRESENTATIONS,
}

# Rules are tried from top to bottom.  Words with an underscore match anywhere in the normalised name,
# other words match a whole token.
QUANTITY_WORDS = [
    ("position_error", ["position_control_deviation", "position_deviation", "position_error", "following_error"]),
    ("surface_roughness", ["surface_roughness", "roughness", "ra"]),
    ("acoustic_emission", ["acoustic_emission", "acoustic", "emission", "ae"]),
    ("depth_of_cut", ["depth_of_cut", "doc", "ap"]),
    ("width_of_cut", ["width_of_cut", "woc", "ae_width"]),
    ("tool_diameter", ["tool_diameter", "diameter"]),
    ("tool_wear", ["tool_wear", "wear", "vb"]),
    ("feed_rate", ["feed_rate", "feedrate", "feed"]),
    ("vibration", ["vibration", "vib", "accelerometer", "acceleration", "acc"]),
    ("force", ["force", "fx", "fy", "fz"]),
    ("torque", ["torque", "moment", "mx", "my", "mz"]),
    ("current", ["current", "ampere", "amps"]),
    ("voltage", ["voltage", "volt"]),
    ("power", ["power", "watt"]),
    ("energy", ["energy", "joule"]),
    ("load", ["load"]),
    ("sound", ["sound", "audio", "microphone", "mic"]),
    ("temperature", ["temperature", "temp"]),
    ("pressure", ["pressure"]),
    ("flow", ["flow"]),
    ("position", ["position", "displacement"]),
    ("velocity", ["velocity"]),
    ("speed", ["spindle_speed", "rotational_speed", "rpm", "speed"]),
]
AXIS_WORDS = [(a, [a]) for a in ["radial", "axial", "tangential", "x", "y", "z", "u", "v", "w", "a", "b", "c"]] + [
    ("x", ["fx"]), ("y", ["fy"]), ("z", ["fz"]), ("x", ["mx"]), ("y", ["my"]), ("z", ["mz"]),
    ("x", ["ax"]), ("y", ["ay"]), ("z", ["az"]), ("u", ["iu"]), ("v", ["iv"]), ("w", ["iw"]),
]
COMPONENT_WORDS = [
    ("spindle", ["spindle"]),
    ("workpiece", ["workpiece", "work_piece", "part"]),
    ("tool", ["tool"]),
    ("axis_drive", ["axis_drive", "feed_drive", "servo", "axis"]),
    ("table", ["table"]), ("motor", ["motor"]), ("fixture", ["fixture"]), ("coolant", ["coolant"]),
    ("environment", ["environment"]), ("machine", ["machine"]),
]
REPRESENTATION_WORDS = [
    ("peak_to_peak", ["peak_to_peak", "peak2peak", "p2p", "ptp"]),
    ("crest_factor", ["crest_factor", "crestfactor"]),
    ("kurtosis", ["kurtosis", "kurt"]),
    ("skewness", ["skewness", "skew"]),
    ("spectrum", ["spectrogram", "spectrum", "fft", "stft", "cwt", "frequency"]),
    ("setpoint", ["setpoint", "set_point"]),
    ("command", ["command", "cmd", "reference"]),
    ("actual", ["actual", "measured"]),
    ("rms", ["rms"]),
    ("std", ["std", "standard_deviation"]),
    ("mean", ["mean", "average", "avg"]),
    ("min", ["minimum", "min"]),
    ("max", ["maximum", "max"]),
    ("peak", ["peak"]),
    ("energy", ["energy"]),
]
CONTROLLER_WORDS = ["signals_machine", "machine_signal", "controller", "cnc", "plc"]
SENSOR_WORDS = ["signals_sensor", "sensor", "accelerometer", "microphone", "dynamometer"]

DERIVED_REPRESENTATIONS = [
    "rms", "mean", "std", "min", "max", "peak", "peak_to_peak", "kurtosis", "skewness", "crest_factor", "spectrum", "energy",
]
PROCESS_CONDITION_QUANTITIES = ["feed_rate", "depth_of_cut", "width_of_cut", "tool_diameter"]
EXTERNAL_SENSOR_QUANTITIES = ["vibration", "acoustic_emission", "force", "sound", "temperature", "pressure", "flow"]
VECTOR_QUANTITIES = ["vibration", "force", "torque", "position", "position_error", "velocity"]
NON_SIGNAL_QUANTITIES = ["depth_of_cut", "surface_roughness", "tool_diameter", "tool_wear", "width_of_cut"]
METADATA_PATTERNS = [
    r"(?:^|_)(?:row|sample|block)_?index(?:_|$)",
    r"(?:^|_)(?:time|timestamp|received_at|created_at|start_time|end_time)(?:_|$)",
    r"(?:^|_)(?:gcode|mcode|filename|source_file|path)(?:_|$)",
    r"(?:^|_)(?:tool|part|machine)_(?:id|number|db_number)(?:_|$)",
    r"(?:^|_)(?:label|labels|target|class|dummy|unnamed)(?:_|$)",
]

EXACT_NAMES = {
    "vx": "external_sensor.unknown.vibration.x.raw",
    "vy": "external_sensor.unknown.vibration.y.raw",
    "vz": "external_sensor.unknown.vibration.z.raw",
    "acc1_value": "external_sensor.unknown.vibration.x.raw",
    "acc2_value": "external_sensor.unknown.vibration.y.raw",
    "acc3_value": "external_sensor.unknown.vibration.z.raw",
    "ai1_01": "external_sensor.unknown.vibration.x.raw",
    "ai1_02": "external_sensor.unknown.vibration.y.raw",
    "ai1_03": "external_sensor.unknown.vibration.z.raw",
    "ai1_07": "external_sensor.unknown.pressure.none.raw",
    "iu": "machine_controller.motor.current.u.actual",
    "iv": "machine_controller.motor.current.v.actual",
    "iw": "machine_controller.motor.current.w.actual",
    "current_u": "machine_controller.motor.current.u.actual",
    "current_v": "machine_controller.motor.current.v.actual",
    "current_w": "machine_controller.motor.current.w.actual",
    "rpm": "machine_controller.spindle.speed.none.actual",
    "sn": "machine_controller.spindle.speed.none.actual",
    "spindle_load": "machine_controller.spindle.load.none.actual",
    "actload": "machine_controller.spindle.load.none.actual",
    "actual_rpm": "machine_controller.spindle.speed.none.actual",
    "command_rpm": "machine_controller.spindle.speed.none.command",
    "actual_feedrate": "machine_controller.machine.feed_rate.none.actual",
    "command_feedrate": "machine_controller.machine.feed_rate.none.command",
    "abs_x": "machine_controller.axis_drive.position.x.actual",
    "abs_y": "machine_controller.axis_drive.position.y.actual",
    "abs_z": "machine_controller.axis_drive.position.z.actual",
    "mechanical_x": "machine_controller.axis_drive.position.x.actual",
    "mechanical_y": "machine_controller.axis_drive.position.y.actual",
    "mechanical_z": "machine_controller.axis_drive.position.z.actual",
    "spindle_x": "external_sensor.spindle.vibration.x.raw",
    "virtual_spindle_vibration_x": "external_sensor.spindle.vibration.x.raw",
    "virtual_spindle_vibration_y": "external_sensor.spindle.vibration.y.raw",
    "virtual_spindle_vibration_z": "external_sensor.spindle.vibration.z.raw",
}

# Channel roles of multi-rate samples.
HIGH_RATE_HINTS = ["vib", "vibration", "accel", "accraw", "acoustic", "ae", "force", "audio"]
CONTROLLER_HINTS = ["focas", "rpm", "feed", "load", "pos", "position", "tool", "gcode", "mcode", "spindle", "servo"]
WAVEFORM_NAMES = ["x", "y", "z", "spindle_x", "vibration_x", "vibration_y", "vibration_z"]
CONTROLLER_PATHS = ["cnc_data", "focas", "coordinate_data", "metadata"]

SEFC_GROUPS = [
    ("setpoint", ["cmd", "setpoint", "program", "feed", "rpm", "spindle_speed"]),
    ("effort", ["load", "current", "power", "torque"]),
    ("feedback", ["actual", "position", "pos", "speed"]),
    ("context", ["tool", "gcode", "mcode", "material", "machine", "block"]),
]
VIEW_HIGH_WORDS = ["vibration", "acceler", "acoustic", "waveform", "hf"]
VIEW_LOW_WORDS = ["rpm", "feed", "axis", "position", "load", "servo", "gcode", "tool"]

# Column order of files without a header row.
VECTOR_AXES = ["x", "y", "z", "u", "v", "w"]
FORCE_TORQUE_NAMES = ["force_x", "force_y", "force_z", "torque_z", "torque_x", "torque_y"]

"""Wear thresholds, model defaults and material parameters."""

WEAR_STAGES = ["healthy", "moderate", "severe"]
HEALTHY_MAX_MM = 0.1
MODERATE_MAX_MM = 0.2
WEAR_LIMIT_MM = 0.3
WEAR_TO_DEFLECTION = 0.4
TAYLOR_DEFAULTS = {"taylor_c": 200.0, "taylor_n": 0.25, "taylor_m": 0.0, "taylor_p": 0.0}
PHYSICS_FEATURES = [
    "tool_life_ratio", "force_ratio", "force_delta_n", "cumulative_energy_j", "specific_cutting_energy_j_per_mm3", "wear_volume_mm3",
]
# material, tool, Taylor C n m p, Kienzle kc1.1 mc, Archard K H, Usui B1 B2
MATERIALS = [
    ("generic_steel", "carbide", 200.0, 0.25, 0.0, 0.0, 1800.0, 0.26, 1.0e-4, 2000.0, 1.0e-5, 4000.0),
    ("Ti6Al4V", "carbide_uncoated", 80.0, 0.22, 0.15, 0.08, 2450.0, 0.21, 5.0e-4, 3200.0, 2.5e-5, 5000.0),
]
MATERIAL_SCHEMA = (
    "material string, tool string, taylor_c double, taylor_n double, taylor_m double, taylor_p double, kc11 double, mc double, "
    "archard_k double, hardness double, usui_b1 double, usui_b2 double"
)

"""Constants of the flood model, in one place (fixed values)."""

# Levels are feet over NAVD88; MLLW lies 2.75 ft below.
MLLW_OFFSET_FT = -2.75
FLOOD_FT = {"minor": 3.25, "moderate": 4.25, "major": 5.25}
PHASE_EPSILON_FT = 0.025
MAX_GAP_S = 12 * 3600
SESSION_GAP_S = 1800
SESSION_MIN_ROWS = 12
PEAK_DISTANCE = 24
PEAK_PROMINENCE_FT = 0.20
TIDES_PER_YEAR = 705
STAGES, STAGE_STEP_C = 281, 5
MODEL_MAX_D = 140
SOURCE_MAX_D = 10
SOURCE_MIN_CELLS = 101
HARD_MIN_D = 75
TILE = 25
HIST_MIN_D, HIST_MAX_D = -100, 140
PENALTY_FT, PENALTY_FROM_FT, PENALTY_TO_FT, PENALTY_POWER = 1.25, 3.25, 5.25, 1.5
RETAINED = 0.25
DEPTH_BREAKS_FT = [0.10, 0.25, 0.50, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0]
WEIR_COEFFICIENT = 3.10
SUBSTEP_S, SUBSTEPS = 60, 15

"""Constants of the hazard model; every operator takes them as overridable keywords."""

from __future__ import annotations

from types import MappingProxyType

# Fixed values, needed for equal results: rainfall thresholds.
ID_COEFFICIENT, ID_EXPONENT = 5.8294, -0.4141
ED_OFFSET, ED_SLOPE = -11.10, 0.62
ED_MIN_HOURS, ED_MAX_HOURS = 24.0, 1440.0
EXCEEDANCE_HOURS = (1, 6, 24, 72)
FEATURE_WINDOWS_HOURS = MappingProxyType({"rain_1h": 1, "rain_6h": 6, "rain_24h": 24, "rain_72h": 72, "antecedent_7d": 168, "antecedent_15d": 360, "antecedent_30d": 720})

# Escalation stages.
YELLOW, ORANGE, RED, HYSTERESIS = 0.25, 0.5, 0.75, 0.1
STAGES = ("GREEN", "YELLOW", "ORANGE", "RED")

# Runout and roads.
RUNOUT_P_FAIL, REACH_ANGLE_DEG, SPREAD_HALF_ANGLE_DEG = 0.5, 25.0, 15.0
P_CRIT_ROAD, P_CRIT_BRIDGE = 0.7, 0.5
CLEARANCE_HOURS = MappingProxyType({"trunk": 24.0, "primary": 24.0, "secondary": 18.0, "tertiary": 12.0, "residential": 6.0, "unclassified": 6.0, "service": 4.0})
CLEARANCE_DEFAULT_HOURS, BRIDGE_CLEARANCE_FACTOR = 12.0, 2.0

# Evacuation priority.
EPS_P, EPS_POP, EPS_RII, EPS_SHELTER = 0.35, 0.25, 0.25, 0.15
EPS_POP_REF, EPS_SHELTER_REF_KM = 200.0, 5.0
EPS_P1, EPS_P2 = 0.65, 0.35

# Safe window.
WINDOW_CRITICAL, WINDOW_MIN_POINTS, WINDOW_MAX_HOURS = 1.0, 3, 72.0
WINDOW_MARGIN, WINDOW_MIN_MARGIN_HOURS, WINDOW_NOW_HOURS, HISTORY = 0.25, 0.5, 1.0, 50

# Routing.
ROUTE_ALPHA, ROUTE_BETA, WALK_KMH = 3.0, 1.0, 4.0

# The earth, by formula.
EARTH_KM, EARTH_M = 6371.0088, 6371008.8

# Reports.
DEDUP_KM, DEDUP_HOURS, HOTSPOT_KM, HOTSPOT_DAYS = 0.25, 72, 2.0, 7
CLOSED = ("actioned", "dismissed")

# Hold-out exclusion.
HOLDOUT_KM, HOLDOUT_DAYS = 10.0, 30

# Forecast factors by day.
FORECAST_FACTORS = (1.0, 1.14, 0.96, 0.74, 0.56)

# Evaluation.
CALIBRATION_EDGES = (0.25, 0.5, 0.75, 1.0)
OPERATING_THRESHOLDS = (0.3, 0.5, 0.7)

# Page rank, cascade.
DAMPING, PAGERANK_ROUNDS, CASCADE_DEFAULT = 0.85, 20, 0.95

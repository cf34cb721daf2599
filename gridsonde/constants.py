"""They must equal the published definitions for right results."""

# Depth axes (metres).
STANDARD_DEPTHS = (0.0, 5.0, 10.0, 20.0, 30.0, 50.0, 75.0, 100.0, 125.0, 150.0, 200.0, 300.0, 500.0, 700.0, 1000.0)
MOORING_SENSOR_DEPTHS = (1.0, 10.0, 20.0, 40.0, 60.0, 80.0, 100.0, 140.0, 200.0, 300.0, 500.0)
PROFILE_DEPTH_MAX = 1000.0

# Basin grid.
GRID_RESOLUTION = 0.25
GRID_LAT_START, GRID_LON_START = 5.125, 45.125
GRID_N_LAT, GRID_N_LON = 100, 240
BASIN_BOX = {"lat_min": 5.0, "lat_max": 30.0, "lon_min": 45.0, "lon_max": 105.0}
SUB_BASIN_LON = 80.0

# Physics.
EARTH_RADIUS_M = 6371000.0
OMEGA = 7.292115e-5
CORIOLIS_FLOOR = 1.5e-5
RHO_AIR = 1.225
DRAG_COEFFICIENT = 1.3e-3
RHO_SEA = 1025.0
BETA_PLANE_LATITUDE = 8.0
ABSOLUTE_SALINITY_RATIO = 35.16504 / 35.0

# Column indices.
HEAT_ISOTHERM = 26.0
THERMOCLINE_ISOTHERM = 20.0
MIXED_LAYER_DRHO = 0.03
ISOTHERMAL_LAYER_DT = 0.2
REFERENCE_DEPTH = 10.0
REFERENCE_DEPTH_TOLERANCE = 0.51
HEAT_CAPACITY = 4178.0
KJ_CM2_PER_J_M2 = 1.0e-7
BARRIER_SIGMA_MAX = 0.15
SERVING_Z20_DEFAULT = 120.0
SERVING_MLD_DEFAULT = 40.0
SERVING_HEAT_FACTOR = 0.428245
LAYER_HEAT_CAPACITY = 3985.0
HEAT_LAYERS = (("0-50", 0.0, 50.0), ("50-100", 50.0, 100.0), ("100-200", 100.0, 200.0), ("200-500", 200.0, 500.0))

# In-situ matching.
MIN_INSITU_DEPTH = 5.0
MATCH_RADIUS_DEG = 0.35
GOOD_FLAGS = ("1", "2")
DT_BINS_HOURS = (("dt_0d", 12.0), ("dt_1d", 36.0), ("dt_2d", 60.0))
MOORING_SITES = (("rama_15n90e", 15.0, 90.0), ("rama_12n90e", 12.0, 90.0))
MOORING_TOLERANCE_HOURS = 12.0

# Climatology and windows.
DAYS_PER_YEAR = 365
CLIMATOLOGY_MIN_SAMPLES = 3
WINDOW_DAYS = 7
INDEX_LAGS = (7, 14)
DIPOLE_WEST = {"lat_min": -10.0, "lat_max": 10.0, "lon_min": 50.0, "lon_max": 70.0}
DIPOLE_EAST = {"lat_min": -10.0, "lat_max": 0.0, "lon_min": 90.0, "lon_max": 110.0}
SPLITS = {
    "train": ("2012-01-01", "2018-12-31"),
    "validation": ("2019-01-01", "2019-12-31"),
    "test": ("2020-01-01", "2021-12-31"),
}

# Masks and quality thresholds.
LAND_ELEVATION = 0.0
COASTAL_BUFFER_CELLS = 2
GRADIENT_BUFFER_CELLS = 1
COVERAGE_LAND_FRACTION = 0.5
CURL_SPIKE = 5e-4
CURL_SPIKE_SHARE = 1e-3

# Source column names that stand for a canonical name, first match wins.
LAT_NAMES = ("lat", "latitude", "nav_lat", "y")
LON_NAMES = ("lon", "longitude", "nav_lon", "x")
DEPTH_NAMES = ("depth", "deptht", "lev", "z", "elevation")
TIME_NAMES = ("time", "t", "valid_time")
SURFACE_ALIASES = {
    "sst": ("delta_sst", "sst"),
    "sss": ("delta_sss", "sss", "sos"),
    "sla": ("delta_sla", "sla"),
    "ugos": ("delta_ugos", "ugos"),
    "vgos": ("delta_vgos", "vgos"),
    "u10": ("delta_u10", "u10"),
    "v10": ("delta_v10", "v10"),
}
RAW_ALIASES = {
    "reanalysis": {"thetao": ("thetao", "temperature"), "so": ("so", "salinity")},
    "sst": {"sst": ("sst", "sst_source")},
    "sealevel": {
        "sla": ("sla", "SLA"),
        "adt": ("adt", "adt_raw"),
        "ugos": ("ugos", "ugosos", "u"),
        "vgos": ("vgos", "vgosos", "v"),
    },
    "sss": {"sss": ("sos", "sss", "so")},
    "winds": {"u10": ("u10", "eastward_wind"), "v10": ("v10", "northward_wind")},
}
MOORING_ALIASES = {
    "ts": ("TIME", "time", "JULD"),
    "depth": ("DEPTH", "depth", "PRES", "plev"),
    "temp": ("TEMP", "T_20", "temperature", "T_11", "theta"),
    "psal": ("PSAL", "S_41", "salinity", "S_12", "practical_salinity"),
    "lat": ("LATITUDE", "lat", "latitude"),
    "lon": ("LONGITUDE", "lon", "longitude"),
}
CHANNELS = (
    "sst", "sss", "sla", "ugos", "vgos", "u10", "v10", "w_e", "f_tilde", "water_column", "doy_sin", "doy_cos",
)
ANOMALY_NAMES = {"thetao": "delta_theta", "so": "delta_sp", "sst": "delta_sst", "sss": "delta_sss"}

# One-atmosphere sea-water density polynomial, coefficients of ascending powers of temperature.
DENSITY_PURE = (999.842594, 6.793952e-2, -9.09529e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9)
DENSITY_S = (0.824493, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9)
DENSITY_S15 = (-5.72466e-3, 1.0227e-4, -1.6546e-6)
DENSITY_S2 = 4.8314e-4

# Heat classes by threshold (kJ/cm2).
HEAT_EXTREME, HEAT_MODERATE = 80.0, 50.0
# Label on display and rule text of each heat class.
HEAT_LABELS = {"UNKNOWN": "NO SOUNDING", "EXTREME": "CRITICAL FUEL", "MODERATE": "MODERATE FUEL", "DEPLETED": "COLD WAKE"}
HEAT_RULES = {
    "UNKNOWN": "TCHP was not reported; intensification fuel cannot be classified.",
    "EXTREME": "TCHP exceeds 80 kJ/cm² — extreme cyclone intensification fuel.",
    "MODERATE": "TCHP is between 50 and 80 kJ/cm² — moderate intensification potential.",
    "DEPLETED": "TCHP is below 50 kJ/cm² — depleted heat / cold-wake regime.",
}

"""Fixed values of the domain; operators take them as defaults."""

HIGH, CANDIDATE, LOW = 0.85, 0.70, 0.50
STRIDE_LAT, STRIDE_LON, HALF_WINDOW = 0.00216, 0.00224, 0.0011
#: south, west, north, east
METRO_BBOX = (14.40, 120.92, 14.78, 121.13)
EARTH_M, EARTH_KM = 6_371_000.0, 6371.0088
METRES_PER_DEGREE, METRES_PER_DEGREE_SITE = 111_320.0, 111_000.0
CONFIRMED_M, HALO_M, LABEL_M, SNAP_M, EXCLUDE_M, SNAP_BOX = 200.0, 300.0, 500.0, 170.0, 240.0, 0.003
KWP_PER_M2, KWP_PER_M2_BUILDING = 0.15, 1 / 6
SATURATED, GROWING = (8, 300.0), (3, 50.0)
# Weights of the composite
WEIGHTS = {"nir": -0.40, "swir": -0.30, "lst": -0.20, "nightlight": 0.10}
BUILT_UP_CLASS, BUILT_UP_KEEP = 50, 0.05
CLOUD_CLASSES, CLOUD_BITS = (1, 3, 8, 9, 10), (3, 4)
DEGRADED_SHARE, ROLLBACK_SHARE = 0.20, 0.05
# Building tags, keys of private data
RESIDENTIAL = ("house", "residential", "detached", "semidetached_house", "terrace", "apartments", "bungalow", "cabin", "dormitory", "barracks")
COMMERCIAL = ("commercial", "industrial", "warehouse", "supermarket", "retail", "office", "school", "kindergarten", "university", "college", "hospital", "church", "civic", "government", "public", "transportation", "depot", "manufacture")
PRIVATE_KEYS = ("is_residential", "building_osm_id", "address", "addr:street", "addr:housenumber", "owner", "owner_name", "occupant")
Z_BOUND = 5.0
PANEL_BRIGHTNESS, PANEL_BLUE = (25, 140), (-25, 60)
# Usual use of a household by its size
USUAL_KWH = {1: (80, 180), 2: (120, 280), 3: (180, 380), 4: (240, 480), 5: (300, 580), 6: (380, 700)}

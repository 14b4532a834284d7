"""Names, keys and defaults that stored files and published results depend on."""

# Detector names; their order gives the fold ids 1, 2, 3, 4.
DETECTORS = ("AGIPD", "JUNGFRAU_4M", "ePix10k", "Eiger4M")

# Names accepted by the geometry lookup.
GEOMETRY_NAMES = ("AGIPD", "JUNGFRAU_4M", "ePix10k", "Eiger4M", "EigerRESoNeT")

# Sample-to-detector distance in metres used for JUNGFRAU_4M when none is given.
JUNGFRAU_DISTANCE = 0.103

# Detector description stored in a file -> (detector, how its frames become an image).
DESCRIPTIONS = {
    "AGIPD 1M": ("AGIPD", "flat"),
    "ePix10k 2.2M": ("ePix10k", "flat"),
    "EIGER 4M": ("Eiger4M", "canvas"),
    "Jungfrau 4M": ("JUNGFRAU_4M", "assembled"),
}

# File suffixes that can hold frames.
SUPPORTED_SUFFIXES = (".img", ".h5", ".cxi")

# Container keys that may hold the frames, in order of preference.
DATA_KEYS = (
    "entry/data/data",
    "entry_1/instrument_1/detector_1/detector_corrected/data",
    "entry_1/data_1/data",
    "entry_0000/instrument/Simulator/data",
)
EXPECTED_KEY = "entry/data/data"
LABEL_KEY = "entry_1/labels/hit"

# Buckets of a session split, in filling order, and the bucket of held-out sessions.
TRAIN, VAL, IN_DOMAIN_TEST = "train", "val", "in_domain_test"
CROSS_DETECTOR = "cross_detector_eval"
SPLIT_RATIOS = (0.80, 0.10, 0.10)
STRICT_VARIANT = "strict_lodo"
SEMI_SUPERVISED_VARIANT = "semi_supervised_lodo"

# Normalisation defaults.
GCN_EPSILON = 1e-6
LCN_EPSILON = 1e-6
LCN_WINDOW = 9
LCN_WINDOWS_COMPARED = (3, 9, 15, 31)
TARGET_SIZE = (224, 224)

# AGIPD frames: modules of 512 x 128 pixels, each made of 8 panels of 64 x 128.
AGIPD_MODULE_SS, AGIPD_MODULE_FS, AGIPD_PANEL_SS = 512, 128, 64

# Training-loop defaults.
PATIENCE = 10

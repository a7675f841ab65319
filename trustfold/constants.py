"""Fixed values of the protocol, stated once."""

# --- credibility rule ---
INITIAL_SCORE = 0.5
REWARD_STEP = 0.1
PENALTY_FACTOR = 0.01
INSECURE_FACTOR = 0.01
REHAB_SCORE_LIMIT = 0.01
REHAB_DISTANCE_FACTOR = 1.5
REHAB_BASE = 0.02
REHAB_BONUS = 0.03
REHAB_CAP = 0.1
REHAB_EVERY = 10

# --- trust thresholds: exclusion from the average, label in the report ---
EXCLUSION_LIMIT = 0.01
ATTACKER_LABEL_LIMIT = 0.001
WEIGHT_EPSILON = 1e-9
DEFAULT_DISTANCE_THRESHOLD = 6.0

# --- dealing, pairing, sampling ---
CLIENTS = 10
SHARDS_PER_CLIENT = 4
DEAL_SEED = 42
HISTORY_KEPT = 30
SUBSET_ROWS = 512
DEFAULT_SUBSET_ROWS = 32

# --- training ---
ROUNDS = 60
EPOCHS = 3
BATCH_ROWS = 64
AUTH_BATCH_ROWS = 32
LEARNING_RATE = 0.01
MOMENTUM = 0.9
WEIGHT_DECAY = 5e-4

# --- image pipeline ---
PIXEL_MAX = 255.0
NORM_MEAN = 0.5
NORM_STD = 0.5
CROP_PAD = 4
FLIP_PROBABILITY = 0.5

# --- corruption kinds ---
NO_CORRUPTION = 0
ADDITIVE_NOISE = 1
REPLACEMENT_NOISE = 2
CONSTANT_VALUE = 3

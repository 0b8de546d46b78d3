"""Fixed values shared by the operators."""

from __future__ import annotations

import os

# --- fixed values: names of folds' splits and of the key column ---------------
ID = "ID"
TRAIN, VALID, TEST = "trn", "val", "tst"
SPLITS = (TRAIN, VALID, TEST)
LABEL_TABLE = "label"

# --- fixed values: default sizes and seeds, overridable by the environment ----
SEED_SPLIT = int(os.getenv("SEED_1", "42"))
SEED_RESAMPLE = int(os.getenv("SEED_2", "43"))
VARIANCE_THRESHOLD = float(os.getenv("VARIANCE_THRESHOLD", "0.01"))
FOREST_TREES = int(os.getenv("NUM_ESTIMATORS", "5000"))
FOREST_FEATURES = int(os.getenv("NUM_FEAT2SAVE", "1000"))
FOREST_SEEDS = tuple(range(45, 55))
TRIALS_PER_FOLD = 10

# --- fixed values: genotype codes 1..10 in this order; 0 = missing/other ------
GENOTYPE_PAIRS = ("AA", "CC", "GG", "TT", "AC", "AG", "AT", "CG", "CT", "GT")
ONEHOT_BITS = len(GENOTYPE_PAIRS)

# --- scale bounds -------------------------------------------------------------
# A side is broadcast only when it was counted and holds at most this many rows;
# beyond it the join is shuffled and salted.
BROADCAST_ROWS = 200_000
SALTS = 32
# Output files aim at this size.
FILE_BYTES = "256MB"

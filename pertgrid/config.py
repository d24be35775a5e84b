"""Constants of the measurement conventions."""

#: Added to CPM before the base-2 ratio of differential expression.
LFC_EPSILON = 1e-9
#: Added to CPM in transfer (natural log).
TRANSFER_PSEUDOCOUNT = 20.0
#: Mean CPM of the reference group that a gene must exceed.
EXPRESSION_GATE = 5.0
CPM_SCALE = 1e6
#: Scale of the log pseudobulk profile.
PROFILE_SCALE = 5e4
FDR = 0.05
STRONG_LFC = 0.5
EXPONENT_CLIP = 80.0
EVIDENCE_TIERS = ((10, "insufficient"), (31, "exploratory"), (101, "usable"))
TOP_TIER = "standard"
"""n below the first bound is insufficient, and so on; from the last bound on it is standard."""

"""Fixed values that results depend on.

Fixed values (must stay exactly as written for results to agree with the reference semantics):
- protein alphabet, gap first, then the 20 amino acids in alphabetical order:
  "-ACDEFGHIKLMNPQRSTVWY"
- confidence threshold for high-confidence labels: 0.8
- identity threshold used when splitting nearest-train identity: 0.4
- predictor (method) names of the augmented table: "msa", "foundation", "contrastive"
- PCA components: 2; replicated targets per label in conditioned generation: 1000
"""

ALPHABET = "-ACDEFGHIKLMNPQRSTVWY"
GAP = "-"
Q = len(ALPHABET)
CONFIDENCE = 0.8
IDENTITY_SPLIT = 0.4
METHODS = ("msa", "foundation", "contrastive")
PCA_COMPONENTS = 2
TARGETS_PER_LABEL = 1000

# Fixture parameters (ours, not the reference's): every document's letters are cut into
# consecutive windows of WINDOW residues; letters outside the alphabet become gaps.
WINDOW = 64
NON_ALPHABET_LETTERS = "BJOUXZ"
# Ranking/threshold comparisons are made on probabilities rounded to this many digits, so
# that last-bit float differences between engines cannot flip an argmax or a threshold.
RANK_DIGITS = 9
OUT_DIGITS = 6

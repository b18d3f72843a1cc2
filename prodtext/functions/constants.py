"""Fixed values that must equal the source workflow's for identical output.

Fixed values (do not edit): the tag vocabulary of the tagged record format,
the span tag map, the render/cleaning thresholds and the readability constants.
"""

# Record tag vocabulary, in the order the record format uses them.
OVERV_START = "<OVERV_START>"
OVERV_END = "<OVERV_END>"
UNK = "<|UNK|>"
PAD = "<|PAD|>"
NAME_START = "<NAME_START>"
NAME_END = "<NAME_END>"
DESCR_START = "<DESCR_START>"
DESCR_END = "<DESCR_END>"
FEAT_START = "<FEAT_START>"
NEXT_FEAT = "<NEXT_FEAT>"
FEAT_END = "<FEAT_END>"

# Inline entity tags and their labels, in tag order (PROD first, then ATTR).
ENTITY_TAGS = [("<prod>", "</prod>", "PROD"), ("<attr>", "</attr>", "ATTR")]
# Metric tag order (ATTR first, then PROD).
METRIC_TAGS = ["ATTR", "PROD"]

# Thresholds and caps.
MAX_SPECS = 10
NEAR_DUP_RATIO = 0.9
COSINE_THRESHOLD = 0.5
MAX_CAPTIONS = 7
MAX_SEQ_LEN = 768
SPLIT_SEED = 42
TRAIN_FRACTION = 0.9
VALID_FRACTION_OF_REST = 0.8
KFOLD_K = 10
GUNNING_WORDS = 100

# Readability constants (Coleman uses 0.269, as the source does).
FLESCH = (206.835, 1.015, 84.6)
COLEMAN = (0.05888, 0.269, 15.8)
GUNNING = 0.4

# Category prompt replacements and overview prompt replacements, in order.
CATEGORY_REPLACEMENTS = [("Yes ", ""), ('"', " inch"), ("Streaming: ", "")]
OVERVIEW_REPLACEMENTS = [("Yes ", ""), ('"', " Inch")]
FEATURE_TEMPLATE = ("this product has ", ".")
# Fixed value: narration of the first slide (the product model goes between).
INTRO = ("Welcome to the ", " review. Take into account that this review is generated automatically by an IA system.")

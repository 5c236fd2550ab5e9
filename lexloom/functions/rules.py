"""Fixed values of the curation and morphology rules, as plain data."""

from __future__ import annotations

# Corpora in processing order, and the target mixture by tokens.
CORPORA = ("bnc_spoken", "childes", "gutenberg", "open_subtitles", "simple_wiki", "switchboard")
MIXTURE = {
    "gutenberg": 0.40,
    "simple_wiki": 0.25,
    "bnc_spoken": 0.15,
    "childes": 0.10,
    "open_subtitles": 0.08,
    "switchboard": 0.02,
}

# Thresholds of the line filters.
MIN_CHARS, MAX_CHARS, MIN_ALPHA = 10, 500, 0.60
CODE_SHARE, TABLE_SHARE = 0.10, 0.30
NEAR_THRESHOLD = 0.85

# Weights of the quality score.
W_LENGTH, W_ALPHA, W_DIGIT, W_PUNCT, W_REPEAT = 20, 40, 15, 15, 10

# Substrings of boilerplate lines.
BOOK_MARKERS = ("project gutenberg", "end of the project", "*** start", "*** end", "e-text", "ebook")

# Affixes in list order.
PREFIXES = [
    "un", "re", "in", "dis", "en", "non", "pre", "de", "mis", "over", "under", "out", "sub", "inter", "fore", "anti",
    "mid", "super",
]
SUFFIXES = [
    "ed", "ing", "ly", "er", "est", "ness", "ment", "ful", "less", "tion", "sion", "able", "ible", "al", "ial", "y",
    "ous", "ious", "ive", "ize", "ise", "en", "ate", "ify", "hood", "ship", "dom",
]
INFLECTIONS = [
    "s", "es", "ed", "ing", "er", "est",
]
MARKER = "@@"

# Special pieces of the two vocabulary families, in id order.
SPECIALS_MARKED = ("<pad>", "<unk>", "<s>", "</s>")
SPECIALS_PLAIN = ("[PAD]", "[CLS]", "[SEP]", "[UNK]")

# Names of the minimal-pair subsets.
SUBSETS = [
    "adjunct_island", "anaphor_gender_agreement", "anaphor_number_agreement", "animate_subject_passive",
    "animate_subject_trans", "causative", "complex_NP_island", "coordinate_structure_constraint_complex_left_branch",
    "coordinate_structure_constraint_object_extraction", "determiner_noun_agreement_1", "determiner_noun_agreement_2",
    "determiner_noun_agreement_irregular_1", "determiner_noun_agreement_irregular_2",
    "determiner_noun_agreement_with_adj_2", "determiner_noun_agreement_with_adj_irregular_1",
    "determiner_noun_agreement_with_adj_irregular_2", "determiner_noun_agreement_with_adjective_1",
    "distractor_agreement_relational_noun", "distractor_agreement_relative_clause", "drop_argument", "ellipsis_n_bar_1",
    "ellipsis_n_bar_2", "existential_there_object_raising", "existential_there_quantifiers_1",
    "existential_there_quantifiers_2", "existential_there_subject_raising", "expletive_it_object_raising", "inchoative",
    "intransitive", "irregular_past_participle_adjectives", "irregular_past_participle_verbs",
    "irregular_plural_subject_verb_agreement_1", "irregular_plural_subject_verb_agreement_2",
    "left_branch_island_echo_question", "left_branch_island_simple_question", "matrix_question_npi_licensor_present",
    "npi_present_1", "npi_present_2", "only_npi_licensor_present", "only_npi_scope", "passive_1", "passive_2",
    "principle_A_c_command", "principle_A_case_1", "principle_A_case_2", "principle_A_domain_1", "principle_A_domain_2",
    "principle_A_domain_3", "principle_A_reconstruction", "regular_plural_subject_verb_agreement_1",
    "regular_plural_subject_verb_agreement_2", "sentential_negation_npi_licensor_present",
    "sentential_negation_npi_scope", "sentential_subject_island", "superlative_quantifiers_1",
    "superlative_quantifiers_2", "tough_vs_raising_1", "tough_vs_raising_2", "transitive", "wh_island",
    "wh_questions_object_gap", "wh_questions_subject_gap", "wh_questions_subject_gap_long_distance",
    "wh_vs_that_no_gap", "wh_vs_that_no_gap_long_distance", "wh_vs_that_with_gap", "wh_vs_that_with_gap_long_distance",
]

# Names of the four metrics.
METRICS = ("raw_log_prob", "normalized_log_prob", "bpc", "bpb")

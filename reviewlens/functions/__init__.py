"""Scalar Column helpers (dates, text, bins, vectors) and fixed values."""

from reviewlens.functions.dates import date_parts, days_between, epoch_to_date
from reviewlens.functions.text import (
    clean_text, collapse_punctuation, combine_text, ngrams, normalize_tokens,
    remove_digits, remove_non_word, remove_stop_words, text_length, tokenize,
)
from reviewlens.functions.bins import (
    compound_bin, extremity_prediction, polarity_bin, right_closed_bin, segment_label,
    segment_number, subjectivity_bin,
)
from reviewlens.functions.vectors import vector_element

__all__ = [
    "date_parts", "days_between", "epoch_to_date",
    "clean_text", "collapse_punctuation", "combine_text", "ngrams", "normalize_tokens",
    "remove_digits", "remove_non_word", "remove_stop_words", "text_length", "tokenize",
    "compound_bin", "extremity_prediction", "polarity_bin", "right_closed_bin", "segment_label",
    "segment_number", "subjectivity_bin", "vector_element",
]

"""Sources and sinks: table scans (S1, S2), fixture adapters, CSV (S5, S6, S8),
local rows (S7) and sampling / repeatable splits (S3, M2)."""

from reviewlens.sources.tables import read_table, scan_reviews, scan_scoring
from reviewlens.sources.fixtures import (
    reviews_from_documents,
    scoring_from_documents,
    texts_from_documents,
    reviews_from_lineitems,
)
from reviewlens.sources.files import write_single_csv, write_csv, read_csv, rows_to_frame
from reviewlens.sources.sampling import bernoulli_sample, hash_fraction, hash_sample, hash_split

__all__ = [
    "read_table", "scan_reviews", "scan_scoring",
    "reviews_from_documents", "scoring_from_documents", "texts_from_documents", "reviews_from_lineitems",
    "write_single_csv", "write_csv", "read_csv", "rows_to_frame",
    "bernoulli_sample", "hash_fraction", "hash_sample", "hash_split",
]

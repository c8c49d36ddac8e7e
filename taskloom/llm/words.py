"""Words of a batch of texts as integer codes, for operators that count or score words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a batch.

    ``codes`` numbers them by ``distinct``; ``doc`` is the row of each; ``starts`` has the
    first word of each row and, last, the number of words.
    """

    def __init__(self, batch: pa.RecordBatch):
        text = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
        split = pc.ascii_split_whitespace(text)
        flat, doc = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        doc = doc[full.to_numpy(zero_copy_only=False)]
        coded = flat.filter(full).dictionary_encode()
        self.rows = batch.num_rows
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary
        self.doc = doc
        self.starts = np.searchsorted(doc, np.arange(self.rows + 1))

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum for each row of a value of each word."""
        return np.bincount(self.doc, weights=per_word, minlength=self.rows)

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

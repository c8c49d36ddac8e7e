"""Repeated word passages by relative Lempel-Ziv parsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import text_batches, texts
from taskloom.llm.repeats import NULL_ID, PrefixHashes, covered, documents, repeated_spans, with_spans

WINDOW = 50
GRAM = 16


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes split at ASCII spaces only."""
    return text.encode("utf-8", "surrogatepass").split()


def word_symbols(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def word_body(text: str):
    symbols = word_symbols(text)
    return lambda start, stop: symbols[start:stop].tobytes()


def window_digests(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = [xxhash.xxh3_128_intdigest(data[8 * i : 8 * i + len(data) - 8 * (size - 1)]) for i in range(size)]
    mask = (1 << 64) - 1
    return np.array([x >> 64 for x in both], dtype=np.uint64), np.array([x & mask for x in both], dtype=np.uint64)


class ReferenceBlock:
    """The contexts of an anchor seen so far, indexed by their windows; each window has the place
    where it stood first, in the document with the smallest id."""

    def __init__(self, window: int):
        self.window = window
        self.index: dict[int, tuple[int, int, int]] = {}
        self.texts: list[np.ndarray] = []

    def factor(self, own: np.ndarray, at: int, key: int, doc: int) -> int:
        """Words of the longest factor that begins with the window at ``at`` and stands in an earlier
        document, along the place that the index has; 0 without one."""
        place = self.index.get(key)
        if place is None or place[0] >= doc:
            return 0
        reference = self.texts[place[1]][place[2] :]
        n = min(len(reference), len(own) - at)
        differ = np.flatnonzero(reference[:n] != own[at : at + n])
        length = int(differ[0]) if len(differ) else n
        return length if length >= self.window else 0  # else the hashes of two windows collide

    def add(self, own: np.ndarray, keys: list[int], doc: int) -> None:
        for at, key in enumerate(keys):
            self.index.setdefault(key, (doc, len(self.texts), at))
        self.texts.append(own)


def repeated_windows(groups: list, window: int = WINDOW) -> list[tuple]:
    """(id, twin, start, size) of windows that stand in a document with a smaller id.

    The contexts of an anchor come by id, and each is parsed greedily against the block of those
    before it: a factor of at least ``window`` words makes its windows repeats, the parse goes on
    with the first window that reaches over the factor's end, so each window at a boundary is
    looked up on its own.
    """
    out = []
    for group in groups:
        if len(group) < 2:
            continue
        block = ReferenceBlock(window)
        for doc, twin, start, size, body in group:
            own = np.frombuffer(body, dtype=np.uint64)
            keys = PrefixHashes(own).of(np.arange(size), window).tolist()
            at, begin = 0, None
            while at < size:
                length = block.factor(own, at, keys[at], doc)
                if length:
                    begin = at if begin is None else begin
                    at += length - window + 1
                else:
                    if begin is not None:
                        out.append((doc, twin, start + begin, at - begin))
                        begin = None
                    at += 1
            if begin is not None:
                out.append((doc, twin, start + begin, size - begin))
            block.add(own, keys, doc)
    return out


SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, spans)`` of every row of ``docs (doc_id, text)``.

    A word goes if a window of ``window`` words of its document covers it that also starts in a
    document with a smaller id. Windows are judged on the input. ``kept`` has the other words with a
    space between them; ``spans`` are the maximal removed runs of words.

    Null and empty texts have no words. A null ``doc_id`` is smaller than all others. Rows that
    share their id never remove each other's words. An empty table gives no rows; other columns
    are not read. Extra options: ``anchor_texts``.
    """
    own = documents(docs)

    def compare(groups):
        return repeated_windows(groups, window)

    spans = repeated_spans(own, word_symbols, word_body, compare, window_digests, window, gram, False, **options)

    def run(batches):
        for batch in text_batches(batches):
            rows = []
            for i, text, found in zip(batch.column(0).to_pylist(), texts(batch), batch.column(3).to_pylist()):
                words, gone = words_of(text), covered(found, window)
                ends = [0, *(x for s in gone for x in s), len(words)]
                kept = [w for a, b in zip(ends[::2], ends[1::2]) for w in words[a:b]]
                marks = [{"start": a, "end": b} for a, b in gone]
                text = b" ".join(kept).decode("utf-8", "surrogatepass")
                rows.append((None if i == NULL_ID else i, len(words), len(words) - len(kept), text, marks))
            long = pa.int64()
            kinds = [long, long, long, pa.string(), pa.list_(pa.struct([("start", long), ("end", long)]))]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return with_spans(own, spans, "left").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

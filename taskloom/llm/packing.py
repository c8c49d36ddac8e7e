"""Best-fit-decreasing packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskloom.llm.common import text_batches, worker_cache

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Padding that a window may keep; beyond it the window is filled up with a cut piece.
SPARE_TOKENS = 16
VOCABULARY = "byte_bpe_50k.json"
#: Tokens that a task holds before it packs them; bounds its memory, not its result.
BLOCK_TOKENS = 4_000_000
#: Words whose ids a Python worker remembers between batches, about 200 bytes each; then it starts anew.
CACHE_WORDS = 200_000
#: How a byte-level vocabulary writes a space.
BYTE_SPACE = "\u0120"
#: White space before a space: such a text is cut only behind other characters.
UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
#: Characters below it are Latin.
COMMON = "\u0250"
#: The words of byte-level vocabularies, as their pre-tokeniser cuts them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) ")

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padding long"
)


class CapacityTree:
    """Segment tree over remaining capacities 0..size: how many open windows have each.

    A node counts the windows in its range of capacities, so the tightest window that
    still takes ``need`` tokens is found in logarithmic time.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, window) with the least capacity that is at least ``need``."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Windows as lists of indexes into ``lengths`` (1..size each); longest first, ties by position."""
    tree, windows = CapacityTree(size), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        if found is None:
            found = size, len(windows)
            windows.append([])
        capacity, w = found
        windows[w].append(i)
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], w)
    return windows


def fast_encoder(path: str) -> Callable[[str], list[int]] | None:
    """An encoder of ordinary text with the same ids, or None if the vocabulary does not allow one.

    Where ids follow the order of the merges, ranked byte pairs give the ids of the merges.
    """
    model = json.loads(Path(path).read_text())["model"]
    merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if [model["vocab"].get(m.replace(" ", "")) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    # byte-level vocabularies write printable bytes as they are and number the others from 256
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(map(byte_of.__getitem__, t)): k for t, k in model["vocab"].items() if k < 256 + len(merges)}
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordTokens:
    """Token ids of whole texts, word by word: a text may be cut before any space that follows
    a non-space, because no token reaches over such a place. Distinct words of a batch are
    looked up, unknown ones are tokenised many at a time, and the ids are gathered by number.
    A text that holds the string of an added token is tokenised as a whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.starts_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.starts_word[k] = token.startswith(BYTE_SPACE)
        self.fast = fast_encoder(path)
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.start = np.zeros(1, dtype=np.int64)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids_of(self, words: list[str], encode: Callable[[str], list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, length of each word) of runs of words that begin with their only space."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = np.array(encode("".join(part)), dtype="<u4")
            at = np.flatnonzero(self.starts_word[ids])
            if len(at) == len(part) and not at[0]:
                yield ids, np.diff(np.append(at, len(ids)))
            else:
                each = [self._plain(w) for w in part]
                yield np.array([i for e in each for i in e], dtype="<u4"), np.array([len(e) for e in each])

    def _learn(self, words: list[str]) -> None:
        # words that end in white space, or have none before them, are not run together with others
        joined = [w for w in words if w[:1] == " " and not w[-1].isspace()]
        rest = [w for w in words if w[:1] != " " or w[-1].isspace()]
        common, rare = [], joined
        if self.fast:  # letters are classed alike by both encoders where Unicode has long been stable
            common, rare = [w for w in joined if max(w) < COMMON], [w for w in joined if max(w) >= COMMON]
        joined = common + rare
        found = [*self._ids_of(common, self.fast), *self._ids_of(rare, self._plain)]
        for k in range(0, len(rest), 4096):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
            found.append((np.array([i for e in each for i in e], dtype="<u4"), np.array([len(e) for e in each], dtype=np.int64)))
        known = len(self.number)
        self.number.update(zip(joined + rest, range(known, known + len(words))))
        ids, lengths = (np.concatenate(x) for x in zip(*found))
        end = int(self.start[-1])
        if end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end + len(ids), dtype="<u4")])
        self.ids[end : end + len(ids)] = ids
        self.start = np.append(self.start, end + np.cumsum(lengths))

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def _gathered(self, words: pa.Array, starts: np.ndarray) -> list[np.ndarray]:
        """The ids of rows of words; ``starts`` has the first word of each row and, last, their number."""
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > CACHE_WORDS:
            self._forget()
        heads = [distinct[c] for c in code[starts[:-1]]]
        number = self._numbers([" " + w for w in distinct])[code]
        number[starts[:-1]] = self._numbers(heads)
        length = np.diff(self.start)[number]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.start[number] - total[:-1], length)]
        return [ids[total[a] : total[b]] for a, b in zip(starts[:-1], starts[1:])]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        count = len(texts)
        whole = np.zeros(count, dtype=bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False) & ~whole
        found: list = [None] * count
        for i in np.flatnonzero(whole):
            found[i] = np.array(self._plain(texts[i].as_py()), dtype="<u4")
        for rows in (np.flatnonzero(~unsafe & ~whole), np.flatnonzero(unsafe)):
            if not len(rows):
                continue
            part = texts.take(pa.array(rows))
            if unsafe[rows[0]]:
                cut = pa.array([_CUT.split(t) for t in part.to_pylist()], pa.list_(pa.string()))
            else:
                cut = pc.split_pattern(part, " ")
            starts = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            for i, ids in zip(rows, self._gathered(cut.flatten(), starts)):
                found[i] = ids
        return found


def _packed(pieces: list[tuple], size: int, spare: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Sequences of pieces (doc, start, ids, doc_tokens) and the pieces left for the next block.

    Windows that lack more than ``spare`` tokens after best fit are filled up with pieces cut
    from the emptiest ones; at most one window stays open. At the end it is cut at powers of
    two, which need no padding.
    """
    windows = [[pieces[i] for i in w] for w in best_fit_decreasing([len(p[2]) // 4 for p in pieces], size)]
    gaps = [size - sum(len(p[2]) for p in w) // 4 for w in windows]
    done = [w for w, g in zip(windows, gaps) if g <= spare]
    pool = sorted(((g, k) for k, g in enumerate(gaps) if g > spare))
    i, j = 0, len(pool) - 1
    while i < j:
        gap, k = pool[i]
        target = windows[k]
        while gap and i < j:
            donor = windows[pool[j][1]]
            doc, start, ids, n = donor.pop()
            take = min(gap, len(ids) // 4)
            target.append((doc, start, ids[: 4 * take], n))
            gap -= take
            if 4 * take < len(ids):
                donor.append((doc, start + take, ids[4 * take :], n))
            if not donor:
                j -= 1
        if not gap:
            done.append(target)
            i += 1
    rest = windows[pool[i][1]] if i == j else []
    if not last:
        return done, rest
    left, room, current = sum(len(p[2]) for p in rest) // 4, 0, []
    for doc, start, ids, n in rest:
        while ids:
            room = room or 1 << (left.bit_length() - 1)
            take, ids = ids[: 4 * room], ids[4 * room :]
            k = len(take) // 4
            current.append((doc, start, take, n))
            start, room, left = start + k, room - k, left - k
            if not room:
                done.append(current)
                current = []
    return done, []


def pack(
    docs: DataFrame,
    sequence_tokens: int = SEQUENCE_TOKENS,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    spare_tokens: int = SPARE_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of all documents, laid into sequences of at most ``sequence_tokens`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. A document is its token
    ids and ``end_id``; overlong ones are first cut into full windows, the rest goes to the
    tightest open window. Every task packs the documents of its own input partition block by
    block, so nothing is shuffled, and a task that runs again packs the same rows alike.
    ``sequence_id`` is the partition number times 2^32 plus a counter.

    Returns ``doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens,
    sequence_id, offset, padding`` (of the whole sequence, at most ``spare_tokens``: the tail of
    a partition is cut at powers of two, which are not padded). Null or empty text: one piece with ``end_id`` alone.
    A null ``doc_id`` stays null; repeated rows are packed as often as they occur; an empty
    table gives no rows.
    """
    path = tokenizer_path or public_tokenizers.path(VOCABULARY)
    size, end = sequence_tokens, np.array([end_id], dtype="<u4").tobytes()

    def rows(windows: list[list[tuple]], base: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(8)]
        for k, window in enumerate(windows):
            at = 0
            for doc, start, ids, n in window:
                length = len(ids) // 4
                for column, value in zip(out, (doc, start, length, ids, n, base + k, at, 0)):
                    column.append(value)
                at += length
            if at & (at - 1):
                for j in range(len(window)):
                    out[7][-1 - j] = size - at
        long = pa.int64()
        kinds = [long, long, long, pa.binary(), long, long, long, long]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padding"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        words = worker_cache(f"words {path}", lambda: WordTokens(path))
        held: list[tuple] = []
        tokens = 0
        for batch in text_batches(batches):
            ids_of = words.encode(pc.fill_null(batch.column(batch.schema.get_field_index("text")), ""))
            whole = []
            for doc, ids in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), ids_of):
                ids = ids.tobytes() + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = (doc, start, ids[4 * start : 4 * (start + size)], n)
                    if len(piece[2]) == 4 * size:
                        whole.append([piece])
                    else:
                        held.append(piece)
                        tokens += len(piece[2]) // 4
            if whole:
                yield rows(whole, base)
                base += len(whole)
            if tokens > block_tokens:
                full, held = _packed(held, size, spare_tokens, last=False)
                tokens = sum(len(p[2]) for p in held) // 4
                for k in range(0, len(full), 1000):
                    yield rows(full[k : k + 1000], base + k)
                base += len(full)
        full, _ = _packed(held, size, spare_tokens, last=True)
        for k in range(0, len(full), 1000):
            yield rows(full[k : k + 1000], base + k)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def packing_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding"
    )

"""The operators for training data against plain Python on small inputs, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from taskloom.llm import decontamination, factors, language, packing, pii, quality, simhash, substrings, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, value int, start int, id long, spans string"
SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, "s", 1, 2, 3, "x") for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def vocabulary(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(seed, n, words=None):
    rng = random.Random(seed)
    words = words or vocabulary(1)
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Null ids and texts, empty and blank texts, equal rows, a repeated id, passages and periodic text."""
    shared = prose(7, 90)
    rows = [
        (None, None, None),
        (None, prose(3, 40) + " " + shared, "en"),
        (1, "", None),
        (2, " \t\n ", "en"),
        (3, prose(4, 70) + "\n" + shared + "\n" + prose(5, 70), "en"),
        (4, prose(6, 20) + " " + shared, "en"),
        (5, shared, "en"),
        (5, shared, "en"),
        (6, "ab " * 300, "de"),
        (7, "x" * 700, "de"),
        (8, prose(8, 5), "de"),
        (8, prose(9, 120), "fr"),
        (9, prose(10, 3000), None),
        (10, prose(11, 30) + " " + " ".join(shared.split()[10:75]), "en"),
        (-3, "é" * 160 + " \U0001f600 end", "fr"),
    ]
    return rows


@pytest.mark.parametrize("anchor_texts", [10_000, 2])
def test_substrings_equal_brute_force(spark, odd_rows, anchor_texts):
    rows = [r for r in odd_rows if not (r[0] == 8 and len(r[1] or "") < 60)]  # distinct ids, but for equal rows
    rows = [r for k, r in enumerate(rows) if r[0] is not None or k]
    seen, expected = {}, {}
    for i, t in sorted({(-(10**9) if i is None else i, t or "") for i, t, _ in rows}):
        data = t.encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - 99):
            if seen.setdefault(data[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        expected[None if i == -(10**9) else i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    found = substrings.remove_repeats(frame(spark, rows), anchor_texts=anchor_texts)
    got = substrings.digest(found).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == expected[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize("anchor_texts", [10_000, 2])
def test_passages_equal_brute_force(spark, odd_rows, anchor_texts):
    low = -(10**9)
    first = {}
    for i, t, _ in odd_rows:
        words = re.findall(SPACE, t or "")
        for p in range(len(words) - 49):
            key, own = tuple(words[p : p + 50]), low if i is None else i
            first[key] = min(first.get(key, own), own)
    expected = []
    for i, t, _ in odd_rows:
        words, own = re.findall(SPACE, t or ""), low if i is None else i
        gone = set()
        for p in range(len(words) - 49):
            if first[tuple(words[p : p + 50])] < own:
                gone |= set(range(p, p + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        expected.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = factors.digest(factors.remove_passages(frame(spark, odd_rows), anchor_texts=anchor_texts)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile([97, 98, 97], 400)]).astype(np.uint8)
    position = np.arange(len(data) - 40)
    group = position % 3
    group.sort()
    order = substrings.SuffixSort(np.concatenate([data, np.zeros(8, np.uint8)]), position, group, 32).order()
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(position)), key=lambda i: (group[i], raw[i : i + 32], i))


def test_word_tokens_are_the_tokenizers_ids():
    """Every id of the plain call, over white space of all kinds, added tokens and rare letters, in small batches."""
    words = packing.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    bits = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u3000", "\u2009", "a", "The", "'s", " don't", "é", "ö", "12", "!", "...",
            "<|endoftext|>", "<|endof", "x", "日本語", "ไทย", "😀", "ab cd", ".", ",", "\u0301", "ǅ", "ʰ", "٣"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(20))) for _ in range(6000)]
    for k in range(0, len(texts), 500):
        part = texts[k : k + 500]
        expected = [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
        assert [ids.tolist() for ids in words.encode(pa.array(part))] == expected


def test_packing_round_trip(spark, odd_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*odd_rows, (20, "a. b, c.\n d ,. .. x1. é,    z. <|endoftext|> don't", "en")]
    pieces = packing.pack(frame(spark, rows), sequence_tokens=256, block_tokens=2_000).collect()
    documents = sorted(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _ in rows)
    by_place, sequences = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
        by_place.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    rebuilt = []
    for (_, n), own in by_place.items():
        own.sort(key=lambda p: p["start"])
        copies = sum(p["length"] for p in own) // n
        assert sum(p["length"] for p in own) == copies * n
        if copies == 1:
            assert [p["start"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own]])[:-1])
            ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), "<u4")
            rebuilt.append((own[0]["doc_id"], tuple(ids.tolist())))
    once = {i for i, _, _ in rows if [r[0] for r in rows].count(i) == 1}
    assert sorted(ids for i, ids in rebuilt if i in once) == sorted(
        tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows if i in once
    )
    assert len(documents) == len(rows)
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own]])[:-1])
        total = sum(p["length"] for p in own)
        assert total <= 256 and {p["padding"] for p in own} == {0 if total & (total - 1) == 0 else 256 - total}
    assert sum({p["sequence_id"]: p["padding"] for p in pieces}.values()) <= 0.07 * sum(p["length"] for p in pieces)
    digest = packing.packing_digest(packing.pack(frame(spark, rows[:6]))).collect()
    assert {r["ids_crc32"] for r in digest if r["doc_id"] == 1} == {zlib.crc32(np.array([1], "<u4").tobytes())}


def test_best_fit_takes_the_tightest_window():
    assert packing.best_fit_decreasing([4, 7, 3, 6], 10) == [[1, 2], [3, 0]]
    rng = random.Random(3)
    lengths = [rng.randint(1, 50) for _ in range(300)]
    windows, rest = [], []
    for i in sorted(range(300), key=lambda k: (-lengths[k], k)):
        fits = [(r, w) for w, r in enumerate(rest) if r >= lengths[i]]
        if not fits:
            rest.append(50 - lengths[i])
            windows.append([i])
        else:
            least = min(r for r, _ in fits)
            w = next(w for r, w in fits if r == least)
            rest[w] -= lengths[i]
            windows[w].append(i)
    got = packing.best_fit_decreasing(lengths, 50)
    fill = lambda ws: sorted(sum(lengths[i] for i in w) for w in ws)
    assert fill(got) == fill(windows) and sorted(i for w in got for i in w) == list(range(300))


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(SPACE, lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, odd_rows):
    base = prose(21, 200).split()
    rows = list(odd_rows)
    for k in range(25):
        words = list(base)
        words[k * 7] = "changed"
        rows.append((100 + k, " ".join(words), "en"))
    rows.append((200, prose(22, 60).upper(), "en"))
    rows.append((201, prose(22, 60), "en"))
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                label[max(root(a), root(b))] = min(root(a), root(b))
    low = -(10**9)
    members = {}
    for k, (i, _, _) in enumerate(rows):
        members.setdefault(root(k), []).append(low if i is None else i)
    expected = sorted(
        (low if i is None else i, f"{prints[k]:016x}", min(members[root(k)])) for k, (i, _, _) in enumerate(rows)
    )
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((low if i is None else i, f, low if c is None else c) for i, f, c in got) == expected
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns
    assert len(kept.collect()) == len({min(v) for v in members.values()})


def test_anchors_cover_and_crowded_anchors_link(spark):
    code = simhash.AnchorCode()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 500, dtype=np.uint64)
    assert np.bitwise_count(x ^ code.nearest(x)).max() <= code.radius
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    (rx, ax), (ry, ay) = simhash.anchors(x, code), simhash.anchors(y, code)
    for i in range(500):
        assert set(ax[rx == i].tolist()) & set(ay[ry == i].tolist())
    centre = np.uint64(x[0])
    near = np.unique(centre ^ simhash.ball(1))
    far = x[1:40]
    fps = [(int(v),) for v in np.unique(np.concatenate([near, far])).view(np.int64)]
    links = simhash.links(spark.createDataFrame(fps, "fp long"), anchor_limit=8).collect()
    label = {f: f for (f,) in fps}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in links:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 4
        label[max(root(a), root(b))] = min(root(a), root(b))
    assert len({root(int(v)) for v in near.view(np.int64)}) == 1


def edit_distance_inside(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_shared_qgrams_are_counted_in_parts(monkeypatch):
    common = "which of the following statements about the river is true "
    passages = [(i, common + f"when item number {i} is taken into account by the reader") for i in range(40)]
    texts = [f"some words before {passages[k][1]} and {common * 3} after" for k in (3, 17)] + [common * 5, ""]
    index = decontamination.PassageIndex.build(passages, decontamination.Q, decontamination.EDIT_RATE)
    whole = decontamination._search(index, texts, decontamination.Q)
    assert {(r, p) for r, p, *_ in whole} >= {(0, 3), (1, 17)}
    for hits in (1, 7, 100):
        monkeypatch.setattr(decontamination, "PART_HITS", hits)
        assert decontamination._search(index, texts, decontamination.Q) == whole


def test_passages_of_a_benchmark(spark):
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    items = [(k, prose(30 + k, 14)) for k in range(6)] + [(9, prose(30, 14)), (10, None), (11, "short"), (None, "")]
    rng = random.Random(4)
    rows = [(None, None, None), (1, "", None), (2, prose(50, 400), "en")]
    for k in range(30):
        text = list(items[k % 6][1])
        for _ in range(k % 9):
            p = rng.randrange(len(text))
            text[p] = rng.choice(["", "q", text[p] + "z"])
        body = "".join(text).upper() if k % 2 else "".join(text).replace(" ", "!! ", 3)
        rows.append((10 + k, prose(60 + k, 50) + " " + body + ". " + prose(90 + k, 30), "en"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    expected = {
        (d, i)
        for d, t, _ in rows
        for i, p in items[:6]
        if edit_distance_inside(plain(p), plain(t or "")) <= int(decontamination.EDIT_RATE * len(plain(p)))
    }
    for block in (4_000_000, 150):
        found = decontamination.find_passages(frame(spark, rows), bench, block_bytes=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    texts = {d: t for d, t, _ in rows}
    passages = dict(items)
    for r in found:
        region = plain(texts[r["doc_id"]][r["start"] : r["end"]])
        assert edit_distance_inside(plain(passages[r["item_id"]]), region) <= r["edits"]
        assert abs(len(region) - len(plain(passages[r["item_id"]]))) <= r["edits"] + 1
    kept = decontamination.without_leaks(frame(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _, _ in rows} - {d for d, _ in expected}


def test_archives_round_trip(spark):
    long = "<p>WARC/1.1\r\n\r\n</p>é" * 80
    rows = [
        (1, "http://a/ b\r\nX: y", long),
        (2, None, long),
        (3, "http://c", long),
        (3, "http://c", "other" * 300),
        (4, "http://d", None),
        (5, "http://e", "small"),
        (6, "http://f", "small"),
        (None, "http://g", long),
        (7, "http://h", "other" * 300),
    ]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.archived(pages).collect()
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None and len(data) >= 1000]
        revisit = i is not None and bool(same) and max(same) != i
        kind = ("revisit", max(same)) if revisit else ("response", None)
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), *kind))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    found = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert all(r["digest"] == r["payload_digest"] for r in got)
    assert warc.archived(pages.where("false")).count() == 0


def plain_personal_data(text):
    def luhn(digits):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(only(m.group())) <= 19 and luhn(only(m.group())):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(only(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "a.b+c@d-e.fg.hi", "@", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "0010.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111",
             "4111  1111 1111 1111", "41111111111111111111", "+1 (437) 555-0689", "+1", "+12.34", "é\U0001f600", "a@b.c_d@e.f", "1 2 3", "\n", " ", "9"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(25)) for _ in range(200)]
    texts += ["", None, "1 " * 20_000, "a" * 20_000 + "@b.c", "4111111111111111 " + "7" * 5_000, "@" * 500, "+" * 500]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(None, "a@b.c", None), (None, "a@b.c", None)]
    got = pii.digest(pii.find_personal_data(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        spans = plain_personal_data(by_id[r["doc_id"]] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), by_id[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [
            sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone")
        ]
        assert r["spans"].split(",id:")[0] == line or not line


def test_contexts_discover_identifiers_and_mask(spark):
    rows = [(k, f"note: passport holder a{k}@mail.org signed on page 3 today", "en") for k in range(40)]
    rows += [(100, "note: passport holder ZX-99812347 signed on page 4 today", "en"), (101, "it is version 20240101 of the file", "en")]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal_data(docs)).collect()}
    assert found[100] == "id:22:33" and found[101] == "" and found[7] == "email:22:33"
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[100] == "note: passport holder <ID> signed on page 4 today"
    assert texts[7] == "note: passport holder <EMAIL> signed on page 3 today"


def test_quality_counts_equal_brute_force(spark, odd_rows):
    rows = [*odd_rows, (30, "a b #$\n a b #$\nx\n\nx\n a b #$\n", "en"), (31, " ".join(["p q r s t u v w"] * 3), "en")]
    trusted = spark.createDataFrame([(3,), (3,), (None,), (9,)], "doc_id long")
    docs = frame(spark, rows)
    got = quality.judge(docs, quality.fit(docs, trusted)).collect()

    def counts(text):
        words = re.findall(SPACE, text or "")
        windows = {}
        for p in range(len(words) - 7):
            windows.setdefault(tuple(words[p : p + 8]), []).append(p)
        covered = {q for at in windows.values() if len(at) > 1 for p in at for q in range(p, p + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed

    key = lambda r: tuple((x is not None, x or 0) for x in r)
    found = [(r["doc_id"], *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in got]
    assert sorted(found, key=key) == sorted([(i, *counts(t)) for i, t, _ in rows], key=key)
    assert not any(r["kept"] for r in got if r["base_failed"])
    none = quality.judge(docs.where("false"), quality.fit(docs.where("false"), trusted))
    assert none.count() == 0


@pytest.mark.parametrize("block_ids", [2, 1000])
def test_quality_ratio_and_verdict_equal_brute_force(spark, block_ids):
    rng = random.Random(4)
    good, bad = vocabulary(11, 40), vocabulary(12, 40)
    rows = [(i, prose(i, rng.choice([5, 25, 60]), good if i % 3 else bad), "en") for i in range(60)]
    rows += [(i, None, "en") for i in (60, 61)] + [(None, prose(70, 30, bad), "en"), (5, prose(71, 30, good), "en")]
    targets = [i for i in range(20) if i % 3] + [60, 1000]
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in [*targets, 1, None]], "doc_id long")
    threshold = 0.0  # a corpus this small moves the ratio little
    got = quality.judge(docs, quality.fit(docs, trusted, block_ids), threshold).collect()

    mask = 2**64 - 1
    a, b = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

    def mix(h):
        h = ((h ^ (h >> 31)) * b) & mask
        return h ^ (h >> 29)

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(SPACE, text or "")]
        return [mix(x) % quality.BUCKETS for x in h] + [mix((x * a + y) & mask) % quality.BUCKETS for x, y in zip(h, h[1:])]

    counts = np.zeros((2, quality.BUCKETS))
    for i, t, _ in rows:
        for g in grams(t):
            counts[1, g] += 1
            counts[0, g] += i in targets
    raw = (counts[1] + 1) / (counts[1] + 1).sum()
    ratio = np.log((counts[0] + quality.PRIOR * raw) / (counts[0].sum() + quality.PRIOR) / raw)
    expected = []
    for i, t, _ in rows:
        found = grams(t)
        mean = float(np.mean(ratio[found])) if found else 0.0
        expected.append((i if i is not None else -1, round(mean, 9), mean >= threshold))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["ratio"], 9), r["ratio"] >= threshold) for r in got) == sorted(expected)
    assert all(r["kept"] == (not r["base_failed"] and r["ratio"] >= threshold) for r in got)
    assert len({r["kept"] for r in got if not r["base_failed"]}) == 2


def test_segmentations_are_summed():
    vocabulary_ = language.Vocabulary(public_tokenizers.path(language.VOCABULARY))
    rng = np.random.default_rng(2)
    probability = np.zeros((len(vocabulary_) + 1, 2))
    probability[:-1] = rng.dirichlet(np.ones(len(vocabulary_)), 2).T + 1e-9
    number = {p: k for k, p in enumerate(vocabulary_.pieces)}

    def total(word, k):
        ways = [1.0] + [0.0] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + language.MAX_PIECE) + 1):
                if word[i:j] in number:
                    ways[j] += ways[i] * probability[number[word[i:j]], k]
        return ways[-1]

    words = [b" the", b" \xc3\xa9tait", b" x", " größer".encode(), b" the"]
    got = language.word_log_likelihoods(vocabulary_, probability, words)
    assert np.allclose(got, [[np.log(total(w, k)) for k in range(2)] for w in words])
    uses = language.expected_counts(vocabulary_, probability[:, 0], words, np.array([1, 2, 1, 1, 1.0]))
    sizes = np.array([len(p) for p in vocabulary_.pieces])
    assert np.isclose((uses * sizes).sum(), 4 + 2 * 7 + 2 + len(words[3]) + 4)


def test_languages_are_told_apart_on_held_out_rows(spark):
    lists = {"xx": vocabulary(100), "yy": vocabulary(200), "zz": [w.replace("a", "ß") for w in vocabulary(300)]}
    rows = [(k, prose(k, 30, lists[lang]), lang) for k, lang in enumerate(list(lists) * 40)]
    odd = [(900, None, "xx"), (901, "", "xx"), (902, "12 34 ...", "yy"), (None, rows[0][1], None), (903, "ab" * 5000, None)]
    train = frame(spark, [r for r in rows if r[0] % 5])
    model = language.fit(train)
    got = language.predict(frame(spark, rows + odd), model).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in rows if i % 5 == 0) >= 23
    assert {found[k]["lang_pred"] for k in (900, 901, 902)} == {"und"} and found[None]["lang_pred"] == "xx"
    empty = language.fit(train.where("false"))
    assert {r["lang_pred"] for r in language.predict(train, empty).collect()} == {"und"}


def test_pairs_of_terms_make_a_text_toxic(spark):
    """Neither word alone is toxic, both together are: no additive model separates these."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(1200):
        words = prose(k, 12).split()
        a, b = k % 2, k // 2 % 2
        words += ["insultword"] * a + ["groupword"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en"))
        labels.append((k, a & b))
    odd = [(5000, None, None), (5001, "", None), (None, "insultword groupword", None), (5002, "INSULTWORD!! Group-Word", None)]
    given = spark.createDataFrame([(i, t, "x") for i, t in labels if i % 5] + [(None, 1, "x"), (7, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(frame(spark, rows), given)
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows + odd), model).collect()}
    held_out = [(got[i]["predicted"], t) for i, t in labels if i % 5 == 0]
    assert sum(p == t for p, t in held_out) >= 0.99 * len(held_out)
    assert got[None]["predicted"] == got[5002]["predicted"] == 1
    assert got[5000]["score"] == got[5001]["score"] < 0.5
    kept = toxicity.clean(frame(spark, rows + odd), model)
    assert kept.columns == frame(spark, rows[:1]).columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got.values())
    blank = toxicity.fit(frame(spark, rows), given.where("false"))
    assert {round(r["score"], 2) for r in toxicity.score(frame(spark, rows[:5]), blank).collect()} == {0.25}


def test_empty_tables(spark):
    none = frame(spark, [(1, "a", "en")]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert decontamination.find_passages(none, bench).count() == 0
    assert decontamination.find_passages(frame(spark, [(1, "a b", "en")]), bench).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert factors.remove_passages(none).count() == 0

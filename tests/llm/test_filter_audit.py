"""The decision diagrams against plain counting over documents."""

import itertools
import random
import re

import pytest

from taskloom.llm import filter_audit


def brute(docs, labels):
    """Every part, order and step by walking over the documents."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    facts = []
    for doc, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 50)
        fails += "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs))
        facts.append((doc, source or "", fails))
    found = {}
    for part in {p for _, p, _ in facts}:
        here = [f for f in facts if f[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                shapley[f] += len(gone)
                found[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(f in x[2] for x in here) - len(gone),
                    sum(x[2] == f for x in here),
                    sum(x[0] in good for x in gone),
                    sum(x[0] in toxic for x in gone),
                ]
        for (p, order, step), row in found.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def result(df):
    rows = [tuple(r) for r in df.collect()]
    found = {r[:3]: r[3:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def odd_documents():
    rng = random.Random(5)
    words = ["one", "two", "Three", "FOUR", "five", "a|b", "six#", "sieben", "acht", "é", "Ünf"] + [f"w{i}" for i in range(80)]
    docs = []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.choice([0, 3, 49, 50, 51, 90])))
        docs.append((i, text, rng.choice(["s0", "s0", "s0", "s1", "", None])))
    docs += [(200 + i, docs[7][1], "s0") for i in range(40)]  # one large group of copies
    docs += [(3, docs[3][1], "s1"), (300, None, "s0"), (301, "", None), (None, "x", "s2"), (None, "x", "s2"), (400, "x", "s2")]
    docs += [(500, "word " * 20_000, "long"), (501, "  \x0b\t", "long"), (502, "Aé" * 40, "long")]
    labels = [(i, i % 3 == 0, i % 7 == 0) for i in range(0, 300, 2)]
    labels = [(i, int(q), int(t)) for i, q, t in labels] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (300, None, 1), (301, 1, None)]
    return docs, labels


def test_steps_equal_plain_counting(spark, odd_documents):
    docs, labels = odd_documents
    d = spark.createDataFrame([(*row, "clash") for row in docs], "doc_id long, text string, source string, quality string")
    found = filter_audit.audit(filter_audit.failure_masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert result(found) == brute(docs, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_masks(docs, labels)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order_once(n):
    order, seen = list(range(n)), set()
    seen.add(tuple(order))
    for k in filter_audit.plain_changes(n):
        order[k : k + 2] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(set(itertools.permutations(range(n))))


def test_swaps_keep_the_counts():
    rng = random.Random(1)
    counts = {m: (rng.randrange(5), rng.randrange(3), 0) for m in rng.sample(range(32), 20)}
    diagram = filter_audit.Diagram(counts, "ABCDE")
    for _ in range(200):
        diagram.swap(rng.randrange(4))
        for mask in range(32):
            node = diagram.root
            for f in diagram.order:
                node = diagram.children[node][mask >> "ABCDE".index(f) & 1]
            assert diagram.total[node] == counts.get(mask, (0, 0, 0))
    # equal subtrees are shared
    even = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, "ABCDE")
    assert len(even.total) == 1 + 6

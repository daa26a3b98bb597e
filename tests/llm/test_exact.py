"""Exact dedup against a plain version, with digests that collide and few held bytes."""

import hashlib
import random

import pytest

from pairlens.llm import exact


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for content, members in groups.items():
        digest, best = hashlib.sha256(content.encode()).hexdigest(), min(members)
        out += [(m[4], best[4], len(members), digest) for m in members]
    return sorted(out, key=str), len(groups)


@pytest.fixture(scope="module")
def rows(words, hard_rows):
    rng = random.Random(2)
    out = list(hard_rows)
    for k in range(40):
        text = words(("exact", k), rng.randrange(0, 30))
        for _ in range(rng.choice([1, 1, 2, 9])):
            out.append((rng.randrange(1000), "".join(rng.choice([" ", "  ", "\n", "\t\r"]) if c == " " else c for c in text)))
    hot = words("hot", 5)
    out += [(2000 + k, hot + " " * (k % 4)) for k in range(120)]
    return out + [(5000, "é x"), (5001, "é x"), (5002, "éx"), (5003, "éx"), (5004, "\x1cx"), (5005, "x")]


@pytest.mark.parametrize(("held", "salts", "key_bytes"), [(exact.HELD_BYTES, exact.SALTS, exact.KEY_BYTES), (200, 3, 1), (0, 1, 2)])
def test_classes(spark, make_docs, rows, held, salts, key_bytes):
    docs = make_docs(rows).repartition(7)
    found = exact.exact_copies(docs, held, salts, key_bytes).collect()
    expected, classes = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=str) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == classes and all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark, make_docs):
    assert exact.exact_copies(make_docs([])).collect() == []

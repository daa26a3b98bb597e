import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest

from pairlens.llm import decontam as D
from pairlens.llm import lines as L

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute_lines(rows, min_chars=20, min_docs=3):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        before = (t or "").split("\n")
        kept = [x for x in before if i is None or len(h := holders.get(key(x), ())) < min_docs or max(h) == i]
        out.append((i, len(before), len(before) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def line_corpus(words):
    rng = random.Random(2)
    shared = [words(("line", i), 6) for i in range(12)] + ["é" * 19, "é" * 20, "ÀÉ straße grüße an alle", "short line"]
    rows = []
    for i in range(60):
        own = [words((i, j), 5) for j in range(4)]
        extra = [rng.choice([str.upper, str.title, lambda x: f" \t{x}\r"])(x) if x.isascii() else x for x in rng.choices(shared, k=3)]
        text = own + extra + ["", "İ" * 25]
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("max_bits", [L.MAX_BITS, L.MIN_BITS])
def test_lines_equal_brute_force(make_docs, line_corpus, hard_rows, max_bits):
    rows = line_corpus + [(i + 1000 if i else i, t) for i, t in hard_rows]
    found = L.line_report(make_docs(rows), max_bits=max_bits).collect()
    expected = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert sum(r.n_dropped for r in found) > 50


def test_lines_texts_and_columns(make_docs, line_corpus):
    docs = make_docs(line_corpus)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    rows = {r.doc_id: r for r in out.collect()}
    for i, _, _, text in brute_lines(line_corpus):
        assert rows[i].text == text and rows[i].n_chars == len(text) and rows[i].score == "mine"
    assert L.line_report(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark, words):
    items = [(1, words("a", 30)), (2, words("b", 50)), (3, words("a", 30)), (4, "only four words here"), (5, None), (6, ""), (None, words("n", 20))]
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), dict(items)


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def test_overlaps(make_docs, benchmark, words):
    table, items = benchmark
    around = lambda t, s: words((s, 1), 40) + " " + t + ".\n" + words((s, 2), 40)
    planted = {
        10: around(items[1], 10),
        11: around(items[2].upper().replace(" ", ", "), 11),
        12: around(changed(items[2], [9, 20, 33, 44]), 12),
        13: around(" ".join(items[2].split()[10:30]), 13),
        14: "only four words here",
        15: items[None],
    }
    clean = {20: around(words("other", 30), 20), 21: around(" ".join(items[2].split()[:8]), 21), 22: "four words only here", 23: " ".join(reversed(items[1].split()))}
    rows = [*planted.items(), *clean.items(), (30, None), (31, ""), (10, planted[10])]
    docs = make_docs(rows)
    found = {(r.doc_id, r.item_id): r for r in D.find_overlaps(docs, table).collect()}
    assert set(found) == {(10, 1), (10, 3), (11, 2), (12, 2), (13, 2), (14, 4), (15, None)}
    assert (found[10, 1].first_word, found[10, 1].n_words, found[10, 1].n_matches) == (40, 30, 30)
    assert (found[12, 2].n_words, found[12, 2].n_matches) == (50, 46)
    kept = D.decontaminate(docs, table)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [20, 21, 22, 23, 30, 31]
    assert D.find_overlaps(make_docs([]), table).count() == 0
    assert D.decontaminate(docs, table.limit(0)).count() == len(rows)


def test_overlap_equals_all_diagonals():
    """Spaced seeds and filters lose nothing that agrees in a run of ten words."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        item, doc = rng.integers(1, 10**6, 30).astype(np.uint64), rng.integers(1, 10**6, 80).astype(np.uint64)
        at = int(rng.integers(0, 50))
        doc[at : at + 30] = item
        doc[at + rng.integers(0, 30)] = 0
        seeds = [set(D.mask_seeds(doc, m).tolist()) & set(D.mask_seeds(item, m).tolist()) for m in D.MASKS]
        assert any(seeds)
        start, n, hits = D.overlap(doc, item, at)
        assert at <= start and n <= 30 and hits >= n - 1 and n >= 15


def test_masks_ignore_their_places():
    words = np.arange(1, 11, dtype=np.uint64)
    for mask in D.MASKS:
        for i, c in enumerate(mask):
            other = words.copy()
            other[i] = 99
            assert (D.mask_seeds(other, mask)[0] == D.mask_seeds(words, mask)[0]) == (c == "0")


def covered(masks, n, out):
    """Whether a mask reads only unchanged words somewhere in a run of n words; out holds the bits of the changed ones."""
    return any(not out & int(m, 2) << at for m in masks for at in range(n - len(m) + 1))


@pytest.mark.parametrize("n, k", [(13, 2), (15, 3), (20, 4), (25, 5)])
def test_masks_cover_every_run(n, k):
    """Every run that counts holds one of these lengths with so many changes at most: of two halves one agrees as well."""
    assert k == n - math.ceil(n * 4 / 5) and not [c for c in combinations(range(n), k) if not covered(D.MASKS, n, sum(1 << i for i in c))]


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_cover_short_items(n):
    for places in combinations(range(n), n - math.ceil(n * 4 / 5)):
        item, doc = np.arange(1, n + 1, dtype=np.uint64), np.arange(1, n + 1, dtype=np.uint64)
        doc[list(places)] = 99
        assert any(set(D.mask_seeds(doc, m).tolist()) & set(D.mask_seeds(item, m).tolist()) for m in D.item_masks(n))


def test_every_fifth_word_changed(make_docs, benchmark, words):
    table, items = benchmark
    docs = make_docs([(1, words("q", 20) + " " + changed(items[2], range(4, 50, 5)) + " " + words("r", 20))])
    assert [(r.doc_id, r.item_id) for r in D.find_overlaps(docs, table).collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="masks cover"):
        D.find_overlaps(docs, table, share=0.7)


def test_overlap_accepts_any_run_that_counts():
    """Against all runs of the diagonal: found when one counts, and then the one with most matches above the share."""
    rng = np.random.default_rng(5)
    cases = [np.arange(15) != 2, np.arange(15) != 12, *[np.arange(n) != i for n in range(5, 14) for i in range(n)]]
    cases += [rng.random(int(rng.integers(1, 45))) < p for p in (0.6, 0.75, 0.85) for _ in range(150)]
    for same in cases:
        n, least = len(same), min(D.MIN_WORDS, len(same))
        item = np.arange(1, n + 1, dtype=np.uint64)
        runs = [(i, j, int(same[i:j].sum())) for i in range(n) for j in range(i + least, n + 1)]
        good = [(5 * m - 4 * (j - i), j - i) for i, j, m in runs if 5 * m >= 4 * (j - i)]
        found = D.overlap(np.concatenate([[0, 0], np.where(same, item, 0)]).astype(np.uint64), item, 2)
        assert (found is not None) == bool(good)
        if found:
            start, words, matches = found
            assert (5 * matches - 4 * words, words) == max(good) and matches == same[start - 2 : start - 2 + words].sum()


def test_changes_near_the_ends_of_an_item(make_docs, spark, words):
    item, short = words("s", 15), words("t", 11)
    table = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    docs = make_docs([(i, words("u", 30) + " " + changed(t, [p]) + " " + words("v", 30)) for i, (t, p) in enumerate([(item, 2), (item, 12), (short, 0), (short, 10)])])
    assert {(r.doc_id, r.item_id) for r in D.find_overlaps(docs, table).collect()} == {(0, 1), (1, 1), (2, 2), (3, 2)}

"""Periodic runs against all periods and places of a text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlens.llm import periodic as P


def brute(ids, min_words=6, min_periods=4):
    """Stretches of every period, left and right maximal, whose period is the smallest."""
    n, out = len(ids), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(ids[k] == ids[k + r] for k in range(start, start + length - r)) for r in range(1, q))
            if length >= max(min_words, min_periods * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(4)
    for _ in range(300):
        ids = []
        while len(ids) < rng.randrange(80):
            part = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 9))]
            ids += part * rng.choice([1, 1, 2, 4, 7]) + part[: rng.randrange(len(part))]
        yield ids


def test_runs_equal_all_periods():
    for ids in sequences():
        assert P.find_runs(ids, 2, 2) == brute(ids, 2, 2)
        assert P.text_runs(np.array(ids, np.int64)) == brute(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_any_sequence(ids):
    assert P.text_runs(np.array(ids, np.int64)) == brute(ids)


def test_long_period_and_fibonacci_word():
    rng = random.Random(8)
    part = [rng.randrange(5000) for _ in range(4000)]
    assert P.text_runs(np.array([-1 + 1, *part * 4, 7001, 7002], np.int64)) == brute_long(part)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert P.text_runs(np.array(b)) == brute(b)
    assert P.find_runs(b, 2, 2) == brute(b, 2, 2)


def brute_long(part):
    """One run of four periods behind a word that does not continue it."""
    assert part[-1] != 0
    return [(1, 16000, 4000)]


def report(rows):
    """The columns of run_report with planted tails, by doc_id."""
    out = {}
    for i, t in rows:
        w = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        names = {x: k for k, x in enumerate(dict.fromkeys(w))}
        runs = brute([names[x] for x in w])
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept)]
        out.setdefault(i, []).append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests))
    return out


def test_report(spark, make_docs, words, hard_rows):
    rows = [r for r in hard_rows if not r[1] or len(r[1]) < 5000]
    rows += [(100 + k, words(("run", k), k, "ab")) for k in range(150)]
    rows += [(300, "a b " * 9), (301, "x\n" * 7 + "X " * 6), (302, "p q r " * 4 + "p q"), (None, "z " * 20)]
    found = P.run_report(make_docs(rows).repartition(3), planted=True).collect()
    expected = report(rows)
    assert len(found) == len(rows)
    assert sorted(map(tuple, found), key=str) == sorted((x for v in expected.values() for x in v), key=str)
    assert sum(r.n_runs > 0 for r in found) > 10


def test_spans_and_kept_words(spark, make_docs):
    rows = P.periodic_runs(make_docs([(1, "so " + "na na hey " * 5 + "end")])).collect()
    assert [tuple(r) for r in rows[0].runs] == [(1, 15, 3)] and rows[0].collapsed == "so na na hey end"
    assert P.periodic_runs(make_docs([])).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5])
def test_short(n):
    assert P.text_runs(np.zeros(n, np.int64)) == []

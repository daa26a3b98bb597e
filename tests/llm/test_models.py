"""Toxicity, mixing, token counts and fingerprints against direct computations."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pairlens.llm import fingerprints as P
from pairlens.llm import mixing as M
from pairlens.llm import queries as Q
from pairlens.llm import token_counts as T
from pairlens.llm import toxicity as X

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


def toxic_corpus(words, n=400):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        text, bad = words(("t", i), rng.randint(5, 60)).split(), i % 5 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["Vileword,", "nastyword", "UGLYWORD."]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark, make_docs, words):
    rows, labels = toxic_corpus(words)
    docs, marks = make_docs(rows), spark.createDataFrame(labels, "doc_id long, label int")
    model = X.train(docs, marks.where(~Q.held_out(marks.doc_id)))
    scores = {r.doc_id: r.score for r in X.score_documents(docs, model).collect()}
    truth = dict(labels)
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.7) == truth[i] for i in unseen]) > 0.95
    assert 0 < len(model.features) < 300
    assert sorted(r.doc_id for r in X.keep_clean(docs, model).collect()) == sorted(i for i in truth if scores[i] < 0.7)
    assert X.keep_clean(docs, model).columns == docs.columns


def test_scores_equal_slow_sum(words):
    rows, labels = toxic_corpus(words, 60)
    texts = pa.array([t for _, t in rows] + [None, "", "  "])
    features = X.text_features(texts)
    model = X.ftrl(features[:60], [y for _, y in labels], X.Settings(l1=0.5))
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    slow = [1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0) for f in row)))) for row in features.copy() for row in [row.tolist()]]
    assert np.allclose(X.scorer(model)(texts), slow)
    # a word, two neighbours, two with one between; each once
    assert len(X.text_features(pa.array(["a b, A"]))[0]) == 2 + 2 + 1


def test_pruning_changes_nothing(words):
    rows, labels = toxic_corpus(words, 80)
    features = X.text_features(pa.array([t for _, t in rows]))
    y = [label for _, label in labels]
    pruned = X.ftrl(features, y, X.Settings(l1=4.0, passes=2))
    rare = {f for f in set(np.concatenate(features).tolist()) if sum(f in set(r.tolist()) for r in features) * 2 <= 4}
    assert not rare & set(pruned.features.tolist())


def test_toxicity_hard_rows(spark, make_docs, hard_rows):
    none = spark.createDataFrame([], "doc_id long, label int")
    model = X.train(make_docs(hard_rows), none)
    scores = X.score_documents(make_docs(hard_rows), model).collect()
    assert len(scores) == len(hard_rows) and all(0 <= r.score < 0.01 for r in scores)
    twice = spark.createDataFrame([(4, 0), (4, 1), (8, None), (None, 1)], "doc_id long, label int")
    assert all(r.score > 0.9 for r in X.score_documents(make_docs(hard_rows), X.train(make_docs(hard_rows), twice)).collect())
    assert X.keep_clean(make_docs([]), model).count() == 0


def test_mixing_meets_targets(spark, make_docs, words):
    rows = [(i, words(("m", i), 40, "abc" if i % 3 else "xyz")) for i in range(300)]
    labelled = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(0, 300, 2)] + [(1, None), (None, "a"), (3, "other")], "doc_id long, domain string")
    mixture = M.fit(make_docs(rows), labelled, {"a": 0.5, "b": 0.5}, ("doc_id",))
    found = M.member_rates(mixture).collect()
    n = sum(r.n_tokens for r in found)
    totals = [sum(r.n_tokens * r.posterior[k] * r.rate for r in found) / n for k in range(2)]
    assert np.allclose(totals, [0.5, 0.5], atol=1e-3)
    assert np.allclose(totals, [r[3] for r in mixture.report()]) and [r[:2] for r in mixture.report()] == [("a", 0.5), ("b", 0.5)]
    assert all(abs(r.posterior[0] - (1 if r.doc_id % 3 else 0)) < 0.3 for r in found)
    assert all(r.rate >= 0 for r in found) and len({round(r.rate, 9) for r in found}) > 2
    again = M.document_rates(make_docs(rows), mixture, "mixed")
    assert again.columns[-1] == "mixed"
    rates = {r.doc_id: r.rate for r in found}
    assert all(abs(r.mixed - rates[r.doc_id]) < 1e-9 for r in again.collect())


def member_table(spark, n, p):
    return spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")


def test_rates_solve_the_problem(spark):
    """At the end no rate can change for the better: the gradient is 0 where a rate is positive, else not negative."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(0, 50, 200)
    targets = np.array([0.9, 0.1, 0.0])
    found = M.fit_rates(member_table(spark, n, p), targets, ridge=0.1, gap=1e-9)
    rates = M.replay(p, found.history, found.step, 0.1)
    weight, share = n / n.sum(), (n[:, None] * p).sum(axis=0) / n.sum()
    metric = np.linalg.inv((p * weight[:, None]).T @ p + M.SOFT * np.diag(share))
    gradient = p @ (metric @ ((weight * rates) @ p - targets)) + 0.1 * (rates - 1)
    assert np.abs(gradient[rates > 1e-6]).max() < 1e-3 and gradient[rates <= 1e-6].min() > -1e-3
    assert (rates >= 0).all() and (rates == 0).any() and (rates > 1).any()


@pytest.mark.parametrize("shares", [[0.05, 0.5, 0.45], [0.02, 0.25, 0.73], [0.2, 2.5, 7.3]])
def test_overlapping_domains_reach_their_targets(spark, shares):
    """With the shipped settings: the smallest domain too, and the gap bounds the distance to a slow plain solver's objective."""
    rng = np.random.default_rng(3)
    p, n, targets = rng.dirichlet(shares, 1500), rng.integers(1, 90, 1500), np.array([0.01, 0.09, 0.9])
    found = M.fit_rates(member_table(spark, n, p), targets)
    rates, weight = M.replay(p, found.history, found.step, M.RIDGE), n / n.sum()
    assert np.allclose((weight * rates) @ p, found.totals, atol=1e-9) and np.allclose(weight @ p, found.before)
    assert found.gap <= M.GAP and np.abs(found.totals - targets).max() < 1e-3
    metric = np.linalg.inv((p * weight[:, None]).T @ p + M.SOFT * np.diag(weight @ p))

    def objective(r):
        left = (weight * r) @ p - targets
        return left @ metric @ left / 2 + M.RIDGE / 2 * weight @ (r - 1) ** 2

    slow = np.ones(1500)
    for _ in range(5000):
        slow = np.maximum(0, slow - (p @ (metric @ ((weight * slow) @ p - targets)) + M.RIDGE * (slow - 1)) / (1 + M.RIDGE))
    assert objective(rates) - objective(slow) <= found.gap * objective(np.ones(1500)) + 1e-12


def test_targets_out_of_reach_show(spark):
    """All posteriors alike: no rates move the shares apart, the totals say so; too few passes leave a gap."""
    alike = M.fit_rates(member_table(spark, [5] * 40, [[0.5, 0.5]] * 40), np.array([1.0, 3.0]))
    assert alike.gap <= M.GAP and abs(alike.totals[0] - alike.totals[1]) < 1e-9 and np.abs(alike.totals - [0.25, 0.75]).max() > 0.1
    p = np.random.default_rng(4).dirichlet([1, 10, 20], 300)
    short = M.fit_rates(member_table(spark, [7] * 300, p), np.array([0.3, 0.3, 0.4]), passes=3)
    assert len(short.history) == 3 and short.gap > M.GAP


def test_mixing_hard_rows(spark, make_docs, hard_rows):
    none = spark.createDataFrame([], "doc_id long, domain string")
    for rows in (hard_rows, [(1, None), (2, "")], []):
        mixture = M.fit(make_docs(rows), none, {"a": 1.0, "b": 3.0}, ("doc_id",))
        found = M.member_rates(mixture).collect()
        assert len(found) == len(rows) and all(r.posterior == [0.5, 0.5] and r.rate >= 0 for r in found)


def thue_morse(n):
    """A word of n letters and its complement, which polynomial hashes modulo 2**64 confuse."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("hash_bits", [64, 9])
def test_token_counts_of_strings_that_share_a_hash(make_docs, words, hash_bits):
    import sentencepiece

    texts = [*thue_morse(1024), *thue_morse(2048), *thue_morse(4096), words("clash", 300), "x  y\n\nz " + words("more", 40), "", None]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = T.token_counts(make_docs(list(enumerate(texts))).repartition(3), MODEL, 20, hash_bits).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}


def test_strong_hashes_differ():
    from pairlens.llm import textops

    spans = [*thue_morse(1024), *thue_morse(64), "", "a", "a\0", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "a" * 64, "a" * 65, "b" * 65, "é" * 40]
    raw = [x.encode() for x in spans]
    data = np.frombuffer(b"".join(raw) * 2, np.uint8)
    ends = np.cumsum([len(x) for x in raw] * 2)
    hashes = textops.strong_hashes(data, ends - [len(x) for x in raw] * 2, ends)
    assert (hashes[: len(raw)] == hashes[len(raw) :]).all() and len(set(hashes.tolist())) == len(raw)


def test_token_counts(make_docs, words, hard_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    special = [" lead", "trail ", "a  b   c", "x\ny\n\nz", "\n", " \n ", "▁a▁▁b", "<s> </s> <unk> <0x0A>", "tab\there", "é ß ü 中文 字", "a　b\xa0c", "\r\n", "  ", "w" * 3000, "a\x00b", "👍🏽 ok"]
    rows = hard_rows + [(100 + i, t) for i, t in enumerate(special)] + [(200 + i, words(("tok", i), 80)) for i in range(40)]
    expected = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    for head in (T.HEAD, 50, 0):
        found = T.token_counts(make_docs(rows), MODEL, head).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
    assert T.token_counts(make_docs([]), MODEL).count() == 0


def brute_chunks(data):
    """Cuts by a gear hash that is rolled byte by byte."""
    out, pos = [], 0
    gear = [int(g) for g in P.GEAR]
    full = [0] * len(data)
    h = 0
    for i, b in enumerate(data):
        h = ((h << 1) + gear[b]) % 2**32
        full[i] = h
    while len(data) - pos > P.MIN:
        end = min(pos + P.MAX, len(data))
        for cut in range(pos + P.MIN, end + 1):
            bits = P.STRICT if cut - pos < P.NORMAL else P.LOOSE
            if full[cut - 1] >> (32 - bits) == 0:
                end = cut
                break
        out.append(end)
        pos = end
    return out + [len(data)] * (pos < len(data))


def test_cuts_equal_rolling_hash(words):
    for text in ("", "a", "abcdefgh", "abcdefghi", "x" * 500, words(1, 400), words(2, 50) + "\n" + words(2, 50)):
        data = text.encode()
        assert P.cuts(np.frombuffer(data, np.uint8)) == brute_chunks(data)
        assert sum(P.chunks([data])[0].values()) == len(data)


def test_shift_resistance(words):
    a = words("s", 600)
    b = "inserted " + a[:1500] + " some more " + a[1500:]
    x, y, z = P.chunks([a.encode(), b.encode(), words("z", 600).encode()])
    assert P.likeness(x, y) > 0.9 and P.likeness(x, z) < 0.05 and P.likeness(x, x) == 1
    assert P.parse(P.render(x)) == x and P.likeness({}, {}) == 1 and P.likeness({}, x) == 0


@pytest.mark.parametrize("range_rows", [4000, 3])
def test_fingerprint_report(make_docs, words, monkeypatch, range_rows):
    monkeypatch.setattr(P, "RANGE_ROWS", range_rows)
    rng = random.Random(7)
    rows = [(i * 3 - 5, words(("f", i), rng.randint(0, 60)) + "é" * (i % 3)) for i in range(40)] + [(500, None), (501, ""), (502, "end")]
    order = sorted(rows)
    found = {r.doc_id: r for r in P.fingerprint_report(make_docs(rng.sample(rows, len(rows)))).collect()}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + after[:n]
        own, changed, following = P.chunks([text.encode(), new.encode(), after.encode()])
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.render(own), P.render(changed))
        assert (r.near_edited, r.near_next) == (P.likeness(own, changed), P.likeness(own, following))


def test_fingerprint_hard_rows(make_docs, hard_rows):
    found = P.fingerprint_report(make_docs(hard_rows)).collect()
    assert len(found) == len(hard_rows)
    single = P.fingerprint_report(make_docs([(1, "abcdefghijklmnop" * 4)])).collect()
    assert len(single) == 1 and single[0].near_next == 1
    assert P.fingerprint_report(make_docs([])).count() == 0
    assert P.fingerprints(make_docs(hard_rows)).count() == len(hard_rows)


def test_long_documents_are_reported_in_slices_of_bounded_length():
    text = "lorem ipsum dolor sit amet " * 1500
    rows = [(i, text + str(i), i, 0, 0) for i in range(120)]
    batch = pa.table(dict(zip(["doc_id", "text", "tie", "part", "guest"], map(list, zip(*rows, strict=True)), strict=True))).to_batches()[0]
    slices = [b.to_pydict() for b in P.reports([batch])]
    assert [d for s in slices for d in s["doc_id"]] == list(range(119))
    assert max(sum(s["n_chars"]) for s in slices) <= P.SLICE_CHARS + len(text) + 3 < 119 * len(text)

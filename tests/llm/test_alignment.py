"""Alignment of whole texts against a plain version on the tokenizer libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pairlens.llm import alignment as G  # noqa: E402

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
PARTS = [
    " ", "  ", "\n", "\t", "a", "b", " the", " The", "é", "ß", "漢", "字", " ", "　", "'s", "'", "1", "23", "<|endoftext|>", "</s>", "▁",
    "\x1c", "\x85", "!", "...", "😀", "é", "﻿", "\r\n", "Ġ", "<0x0A>", "tion", " x", "​", "İ", "ﬁ",
]


def plain(text):
    """Ids of both models and groups of one text, byte by byte."""
    import sentencepiece
    import tokenizers

    a, b = plain.__dict__.setdefault("models", None) or (tokenizers.Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]))
    plain.models = (a, b)
    a.encode_special_tokens = True
    if not text:
        return [], [], []
    byte_of = G.byte_characters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, b.id_to_piece(ids_b))]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], []
    groups, x, y, left, right = [], [], [], 0, 0
    pa, pb = list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))
    while pa or pb or x or y:
        if x and y and left == right:
            groups.append((x, y))
            x, y = [], []
        elif pa and left <= right:
            i, raw = pa.pop(0)
            x, left = x + [i], left + len(raw)
        elif pb:
            i, raw = pb.pop(0)
            y, right = y + [i], right + len(raw)
    return ids_a, ids_b, groups


def brute(rows):
    docs, docs_of = [], Counter()
    for i, text in rows:
        ids_a, ids_b, groups = plain(text)
        links = Counter((p, q) for x, y in groups for p in x for q in y)
        docs_of.update(links.keys())
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if ids_a else ""
        docs.append((i, len(ids_a), len(ids_b), len(groups), links, digest))
    most = defaultdict(int)
    for (p, _), n in docs_of.items():
        most[p] = max(most[p], n)
    return [
        (i, a, b, g, sum(links.values()), sum(n for k, n in links.items() if docs_of[k] == most[k[0]]), sum(n * docs_of[k] for k, n in links.items()), d)
        for i, a, b, g, links, d in docs
    ]


@pytest.fixture(scope="module")
def rows(words, hard_rows):
    rng = random.Random(6)
    out = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in hard_rows]
    out += [(100 + k, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 20)))) for k in range(250)]
    return out + [(500 + k, words(("align", k), 40, "etaoin")) for k in range(20)]


@pytest.mark.parametrize("head", [G.HEAD, 40, 0])
def test_report(spark, make_docs, rows, head):
    found = G.alignment_report(make_docs(rows).repartition(5), *PATHS, head_rows=head).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute(rows), key=str)


def test_long_text_and_small_cache(spark, words, monkeypatch):
    monkeypatch.setattr(G, "CACHE", 50)
    monkeypatch.setattr(G, "CHUNK", 7)
    model = G.Aligner(*PATHS)
    text = words("long", 3000, "abcde") + "\n  end "
    n_a, n_b, n_groups, n_links, digest, _, _ = next(G._block(model, [text]))
    ids_a, ids_b, groups = plain(text)
    assert (n_a, n_b, n_groups) == (len(ids_a), len(ids_b), len(groups))
    assert digest == hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()


def test_slices():
    assert G.common_slices([2, 3, 5, 9], [3, 4, 9]) == ([3, 9], [2, 4], [1, 3])
    assert G.common_slices([], []) == ([], [], [])


def test_empty(spark, make_docs):
    assert G.alignment_report(make_docs([]), *PATHS).collect() == []

"""Personal data, WARC bundles and perspective rotation."""

import hashlib
import random
import re

import pytest
import zstandard

from pairlens.llm import chat as C
from pairlens.llm import pii
from pairlens.llm import warc as W

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def test_plain_spans_equal_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.2@3+ -()_%9é") for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "a@b.c_d@e.f", "@x.y a@@b.c", "a@b a@b.c."]
    for text in texts:
        assert pii.plain_spans(text) == {k: [m.span() for m in re.finditer(p, text) if holds(k, m[0])] for k, p in PATTERNS.items()}


@pytest.mark.parametrize(
    "text,kind,source,identifier",
    [
        ("mail john (at) mail (dot) com now", "email", "john (at) mail (dot) com", "john@mail.com"),
        ("write jane.doe [at] example.com ok", "email", "jane.doe [at] example.com", "jane.doe@example.com"),
        ("bob AT example DOT com", "email", "bob AT example DOT com", "bob@example.com"),
        ("x92 at mail2.example.com", "email", "x92 at mail2.example.com", "x92@mail2.example.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("ça jоhn@exаmple.com", "email", "jоhn@exаmple.com", "john@example.com"),
        ("call plus one five five five one two three four five six seven.", "phone", "plus one five five five one two three four five six seven", "+15551234567"),
        ("four" + " one" * 15, "card", "four" + " one" * 15, "4" + "1" * 15),
        ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("1.2.３.4", "ip", "1.2.３.4", "1.2.3.4"),
    ],
)
def test_disguises_map_back(text, kind, source, identifier):
    spans = pii.find_spans("é\n" + text)
    assert [(k, ("é\n" + text)[a:b], i, added) for k, a, b, i, added in spans] == [(kind, source, identifier, True)]


@pytest.mark.parametrize("text", ["look at example.com", "un deux dos", "at 3 one two", "he sat at the dot", "two dot one", "meet at noon. Bob", "", None, "naïve café – ok"])
def test_clean_texts_stay(text):
    assert pii.find_spans(text) == []


def test_long_disguised_name():
    """The span starts at the first part, however far the at sign is."""
    for parts in (3, 12, 400):
        name = " [dot] ".join(f"part{k}x" for k in range(parts))
        text = f"write to {name} [at] example [dot] com today"
        found = [s for s in pii.find_spans(text) if s[0] == "email"]
        assert found == [("email", 9, text.index(" today"), name.replace(" [dot] ", ".") + "@example.com", True)]
    assert pii.find_spans("a dot " * 20_000 + "b" + " " * 50_000 + "x at y") == []


def test_plain_ones_stay_beside_added():
    spans = pii.find_spans("a@b.com, c (at) d (dot) org, +1 743 555 3824")
    assert [(s[0], s[4]) for s in spans] == [("email", False), ("email", True), ("phone", False)]


def test_personal_spans(make_docs, hard_rows):
    rows = hard_rows + [(50, "é a@b.com " + "x " * 50_000 + "1.2.3.4")]
    found = pii.personal_spans(make_docs(rows)).collect()
    assert len(found) == len(rows)
    assert [[(s.kind, s.start, s.end) for s in r.spans] for r in found if r.doc_id == 50] == [[("email", 2, 9), ("ip", 100_010, 100_017)]]
    assert sum(len(r.spans) for r in found) == 2 and pii.personal_spans(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def pages(spark, words):
    long, longer = words("p", 400), "é" * 600
    rows = [(1, long), (2, long), (9, long), (3, longer), (4, longer), (5, "small"), (6, "small"), (7, ""), (8, None), (9, long), (None, long), (10, words("q", 20_000))]
    return spark.createDataFrame([(i, f"http://x/{i}\r\ny" if i != 4 else None, h, "mine") for i, h in rows], "page_id long, url string, html string, digest string"), rows


def test_bundles_round_trip(pages, spark, tmp_path, monkeypatch):
    table, rows = pages
    path = str(tmp_path / "bundles")
    W.write_bundles(table, path, frame_bytes=2000, bundle_bytes=20_000)
    found = W.read_bundles(spark, path).collect()
    largest = {}
    for i, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, h in rows:
        data, top = (h or "").encode(), largest[h or ""]
        again = len(data) >= 1000 and i != top
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str) == sorted(expected, key=str)
    payloads = {(r.page_id): bytes(r.payload) for r in found if r.record_type == "response"}
    assert payloads[10] == dict(rows)[10].encode() and payloads[8] == b""
    # each file is one Zstandard stream, and one record is read from one frame
    files = sorted((tmp_path / "bundles").glob("part-*"))
    for file in files:
        data = file.read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        reader = W.Reader(data)
        assert whole == b"".join(reader.frame(k) for k in range(len(reader.sizes)))
        for identifier, frame, offset, length in reader.index:
            assert reader.record(frame, offset, length)["fields"]["WARC-Record-ID"] == identifier
    assert len(files) > 1 and len(W.Reader(files[0].read_bytes()).sizes) >= 1


def test_bundles_empty_and_damaged(spark, pages, tmp_path):
    W.write_bundles(pages[0].limit(0), str(tmp_path / "none"))
    assert W.read_bundles(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        W.Reader(b"x" * 100)


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 2, "bob", "Hello"),
        (2, 0, "system", "alone"), (3, None, None, "x"), (3, 1, "user", ""), (None, 5, "user", "y"),
    ]
    table = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, participant string")
    rows = C.perspectives(table).collect()
    found = {(r.conv_id, r.participant): r for r in rows}
    assert set(found) == {(1, "ann"), (1, "bob"), (3, "unknown"), (3, "user"), (None, "user")}
    ann = found[1, "ann"]
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <​|im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    own = [ann.text[int(a) : int(b)] for a, b in (m.split(":") for m in ann.masks.split(","))]
    assert own == ["Hi <​|im_end|><|im_end|>\n", "<|im_end|>\n"] and ann.n_masked == sum(map(len, own)) and ann.n_turns == 4
    assert found[1, "bob"].text.count("assistant\n") == 1
    # a turn without number is a block of its own
    unknown = {r.block: r.text for r in rows if r.participant == "unknown"}
    assert unknown == {None: "<|im_start|>assistant\nx<|im_end|>\n", 0: "<|im_start|>user name=user\n<|im_end|>\n"}
    assert C.perspectives(table.limit(0)).count() == 0


def test_long_dialogue_in_segments(spark):
    rows = [(1, i if i < 40 else 40, "a" if i % 2 else "b", f"t{i:03d}") for i in range(100)]
    found = C.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment=16).collect()
    mine = sorted((r for r in found if r.participant == "a"), key=lambda r: (r.block, r.part))
    assert all(r.n_turns <= 16 for r in found) and sum(r.n_turns for r in mine) == 100
    assert re.findall("t[0-9]{3}", "".join(r.text for r in mine))[:40] == [f"t{i:03d}" for i in range(40)]
    assert sum(len(r.masks.split(",")) for r in mine if r.masks) == 50

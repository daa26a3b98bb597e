"""Exact dedup: equal texts keep one row, found by combining in three steps that all compare whole contents.

A text's content is the text without the characters of X.WHITE. Its digest (SHA-256) only says where to look.

1. Every task deduplicates what it reads: a dictionary by content gives each row the head of its class in that
   task. A task holds HELD_BYTES of contents; then it sends its heads on and starts anew, which only makes more heads.
2. Heads whose digest no other head has are classes. Of the others, groups of (digest, salt, content) are merged:
   a group of copies, however large, is spread over SALTS groups and combined before it moves.
3. The salts' winners are merged by (digest, content).

Rows then learn their class by digest. Should a digest have several contents, its rows learn it through their
heads, which know the content: the result never rests on a digest alone. Contents move only where a digest
occurs in several heads; rows without copies, and copies read by one task, move as digests.

Of a class, the row with the most code points in its original text stays, then the smallest doc_id, then the
first one read. Defined results: null counts as empty; texts of white space equal the empty one; of equal rows
with one doc_id exactly one stays; rows without doc_id take part and come last among texts of one length; texts of any
length are compared whole; an empty table gives an empty table. Other columns than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm import textops as X
from pairlens.llm.common import arrow_map, join_hot, split_by_keys
from pairlens.session import written

#: Bytes of contents that a task keeps before it sends its heads on.
HELD_BYTES = 32 << 20
SALTS = 64
#: Bytes of the digest that make the key; any number gives the same result.
KEY_BYTES = 16
ROWS = pa.schema([("row", pa.int64()), ("head", pa.int64()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("digest", pa.binary()), ("copies", pa.int64()), ("content", pa.binary())])


def content_of(text: bytes) -> bytes:
    return text.translate(None, X.WHITE.encode())


def _local(docs: DataFrame, held_bytes: int) -> DataFrame:
    """A record (row, head, doc_id, n_chars, digest) per row, and one with copies and content per head, of its best row."""

    def run(batches):
        heads: dict[bytes, list] = {}  # content -> head, best row's (row, n_chars, doc_id), digest, copies
        held, row = 0, TaskContext.get().partitionId() << 36

        def sent():
            found = list(heads.items())
            heads.clear()
            for first in range(0, len(found), 1000):
                part = found[first : first + 1000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[k] for _, h in part], ROWS.field(k).type) for k in range(6)] + [pa.array([c for c, _ in part], pa.binary())], schema=ROWS
                )

        for batch in batches:
            data, offsets = X.text_buffer(batch.column(1))
            data, offsets = data.tobytes(), offsets.tolist()
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            records = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                content = content_of(data[offsets[i] : offsets[i + 1]])
                head = heads.get(content)
                if head is None:
                    heads[content] = head = [row, row, doc_id, lengths[i], hashlib.sha256(content).digest(), 0]
                    held += len(content)
                head[5] += 1
                if (-lengths[i], doc_id is None, doc_id or 0) < (-head[3], head[2] is None, head[2] or 0):
                    head[0], head[2], head[3] = row, doc_id, lengths[i]
                records.append((row, head[1], doc_id, lengths[i], head[4], None, None))
                row += 1
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*records, strict=True), ROWS, strict=True)], schema=ROWS)
            if held > held_bytes:
                yield from sent()
                held = 0
        yield from sent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(arrow_map(rows, run, "row long, head long, doc_id long, n_chars long, digest binary, copies long, content binary"), "local_copies")


def _merged(heads: DataFrame, *keys: str) -> DataFrame:
    return heads.groupBy(*keys, "content").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def exact_copies(docs: DataFrame, held_bytes: int = HELD_BYTES, salts: int = SALTS, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id (doc_id of its class's row that stays), group_size, kept, text_sha256 (of the content)."""
    local = _local(docs, held_bytes).withColumn("key", F.substring("digest", 1, key_bytes))
    members = local.where("copies IS NULL").select("row", "head", "doc_id", "key", "digest")
    best = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("best")
    heads = local.where("copies IS NOT NULL").select("head", "key", F.xxhash64("key").alias("place"), "content", best, "copies")

    shared = written(heads.groupBy("place").count().where("count > 1").select("place"), "shared_digests")
    several, alone = split_by_keys(heads, "place", shared)
    salted = _merged(several.withColumn("salt", F.pmod(F.xxhash64("head"), F.lit(salts))), "key", "salt")
    classes = alone.select("key", "content", "best", "copies").unionByName(_merged(salted, "key"))
    classes = written(classes.select("key", "content", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "copies"), "copy_classes")

    sizes = classes.groupBy("key").agg(F.count("*").alias("contents"), F.first("keep_id").alias("keep_id"), F.first("keep_row").alias("keep_row"), F.first("copies").alias("copies"))
    sizes = written(sizes, "digest_classes")
    one = sizes.where("contents = 1").select("key", "keep_id", "keep_row", "copies", F.col("copies").alias("group_size"))
    usual = join_hot(members, one, ["key"], "copies", "left")
    found = usual.where("group_size IS NOT NULL").drop("head")

    clash = written(sizes.where("contents > 1").select("key"), "digest_clashes")
    doubtful, _ = split_by_keys(heads, "place", clash.select(F.xxhash64("key")))
    doubtful = doubtful.join(clash, "key", "left_semi").select("head", "key", "content")
    own = doubtful.join(classes.withColumnRenamed("copies", "group_size"), ["key", "content"]).drop("key", "content")
    rest = usual.where("group_size IS NULL").drop("keep_id", "keep_row", "group_size").join(own, "head").drop("head")

    out = found.unionByName(rest)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

"""Encoding a corpus with a public byte-level BPE: every distinct word is encoded once, not every occurrence.

The pre-tokens of the texts ("words") are numbered within blocks of documents; a block keeps, in reading order, the
number of each occurrence, so that a position costs a byte or two. Only the distinct words of a block are exploded and
shuffled by word: a word that makes up a third of the corpus is one row per block, and in a very large corpus its rows meet in several places. Where the rows of a word meet, it is
encoded once; its ids go back to the blocks, which put the ids of their documents together by position.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewalk.storage import written

#: Where the vocabulary files lie on the driver's machine; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits text into pre-tokens. Fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text per block; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: A worker forgets its words beyond this number, to bound its memory; forgotten words are encoded again.
MOST_WORDS = 1_000_000
#: A word's rows meet once for each 2**10 input partitions: over more input, those of a common word would fill a task.
PARTS_PER_WORD = 10

_LOADED: dict = {}


def ranks(vocabulary: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token bytes to ids of a ``.tiktoken`` file."""
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(vocabulary: str, table: dict[bytes, int]):
    """The encoder of a vocabulary, made once per process."""
    if vocabulary not in _LOADED:
        import tiktoken

        _LOADED[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _LOADED[vocabulary]


def _sent(spark: SparkSession, vocabulary: str, folder: str):
    """The vocabulary as a broadcast, read on the driver alone: executors need no folder of their own. It is as large as the
    vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast(ranks(vocabulary, folder))


def splitter():
    if "split" not in _LOADED:
        import regex

        _LOADED["split"] = regex.compile(PATTERN).findall
    return _LOADED["split"]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    ids, texts, chars = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and chars + len(text or "") > most:
                yield ids, texts
                ids, texts, chars = [], [], 0
            ids.append(i)
            texts.append(text)
            chars += len(text or "")
    if ids:
        yield ids, texts


def _number(id_type: pa.DataType, block_chars: int):
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("no", pa.int32()),
            ("word", pa.string()),
            ("place", pa.binary()),
            ("docs", pa.list_(id_type)),
            ("lens", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        split = splitter()
        for k, (ids, texts) in enumerate(_blocks(batches, block_chars)):
            block = (TaskContext.get().partitionId() << 32) + k
            numbers, places, lens = _Numbers(), [], []
            for text in texts:
                got = np.fromiter(map(numbers.__getitem__, split(text or "")), np.int32)
                places.append(got)
                lens.append(len(got))
            place = np.concatenate(places)
            if len(numbers) <= 65536:
                place = place.astype(np.uint16)
            n = len(numbers)
            words = pa.table(
                [
                    pa.array(np.full(n, block)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(list(numbers), pa.string()),
                    pa.nulls(n, pa.binary()),
                    pa.nulls(n, schema.field("docs").type),
                    pa.nulls(n, schema.field("lens").type),
                ],
                schema=schema,
            )
            yield from words.to_batches(max_chunksize=50_000)
            yield pa.record_batch(
                [
                    [block],
                    pa.array([-1], pa.int32()),
                    pa.nulls(1, pa.string()),
                    [zlib.compress(place.tobytes(), 1)],
                    pa.array([ids], schema.field("docs").type),
                    pa.array([lens], schema.field("lens").type),
                ],
                schema=schema,
            )

    return run


def _encode(vocabulary: str, sent, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoding(vocabulary, sent.value).encode_ordinary, {None: None}
        for batch in batches:
            words = batch.column("word").to_pylist()
            if len(known) >= most_words:
                known = {None: None}
            for word in words:
                if word not in known:
                    known[word] = np.array(encode(word), "<i4").tobytes()
            place = batch.column("place").to_pylist()
            payload = [known[w] if p is None else p for w, p in zip(words, place)]
            yield pa.record_batch(
                [
                    batch.column("block"),
                    batch.column("no"),
                    pa.array(payload, pa.binary()),
                    batch.column("docs"),
                    batch.column("lens"),
                ],
                ["block", "no", "payload", "docs", "lens"],
            )

    return run


def _assemble(id_col: str, id_type: pa.DataType):
    import zlib

    def run(block: pa.Table) -> pa.Table:
        no = block.column("no").to_numpy()
        payload = block.column("payload").to_pylist()
        at = int(np.flatnonzero(no == -1)[0])
        docs, lens = block.column("docs")[at], np.array(block.column("lens")[at].as_py(), np.int64)
        n = len(no) - 1
        order = np.argsort(no)[1:]
        parts = [payload[i] for i in order]
        size = np.array([len(p) // 4 for p in parts], np.int64)
        start = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(b"".join(parts), "<i4")
        place = np.frombuffer(zlib.decompress(payload[at]), np.uint16 if n <= 65536 else np.int32).astype(np.int64)
        sizes = size[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(start[place], sizes)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])]
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids[source], pa.int32()))
        return pa.table([pa.array(docs.as_py(), id_type), lists], [id_col, "ids"])

    return run


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    block_chars: int = BLOCK_CHARS,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, by ``vocabulary``, without special tokens.

    A null text and an empty one both have the empty list. Strings of special tokens are ordinary text. Rows are kept as
    they are: repeated or null ids give as many rows. Whole texts are encoded; other columns don't matter. Read ``docs``
    from files (or write them first): a lost task has to find the same rows in the same order again.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    numbered = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        _number(arrow, block_chars),
        f"block bigint, no int, word string, place binary, docs array<{name}>, lens array<int>",
    )
    many = F.shiftright("block", 32 + PARTS_PER_WORD)
    spread = F.when(F.col("word").isNull(), F.xxhash64("block")).otherwise(F.xxhash64("word", many))
    by_word = numbered.repartition(spread)
    encoded = by_word.mapInArrow(
        _encode(vocabulary, _sent(docs.sparkSession, vocabulary, folder), most_words),
        f"block bigint, no int, payload binary, docs array<{name}>, lens array<int>",
    )
    return encoded.groupBy("block").applyInArrow(_assemble(id_col, arrow), f"{id_col} {name}, ids array<int>")


def decode_corpus(
    encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """``id_col`` and ``text`` of encoded rows, by joining the token-byte table, which has as many rows as the vocabulary
    has ids and is therefore broadcast. The empty list gives the empty text, a null list null. Repeated and null ids give as many rows."""
    spark = encoded.sparkSession
    names = pd.DataFrame([(i, b.hex()) for b, i in ranks(vocabulary, folder).items()], columns=["id", "hex"])
    tokens = F.broadcast(spark.createDataFrame(names, "id int, hex string"))
    exploded = encoded.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", id_col, F.posexplode_outer("ids").alias("pos", "id"), F.col("ids").isNull().alias("is_null")
    )
    joined = exploded.join(tokens, "id", "left")
    whole = joined.groupBy("_row", id_col).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hex"))).alias("parts"), F.max("is_null").alias("is_null")
    )
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")), "utf-8")
    return whole.select(id_col, F.when(~F.col("is_null"), text).alias("text"))


def count_tokens(
    docs: DataFrame, text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """``docs`` with a bigint column ``tokens`` in place of the text: 0 for null and empty texts."""

    sent = _sent(docs.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split, known = encoding(vocabulary, sent.value).encode_ordinary, splitter(), {}
        for batch in batches:
            counts = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                total = 0
                for word in split(text or ""):
                    if (n := known.get(word)) is None:
                        if len(known) >= MOST_WORDS:
                            known.clear()
                        n = known[word] = len(encode(word))
                    total += n
                counts.append(total)
            at = batch.schema.get_field_index(text_col)
            columns = [pa.array(counts, pa.int64()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, ["tokens" if i == at else n for i, n in enumerate(batch.schema.names)])

    schema = ", ".join(
        "tokens bigint" if f.name == text_col else f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
    )
    return docs.mapInArrow(run, schema)


def encoded_table(docs: DataFrame, **how) -> DataFrame:
    """``encode_corpus``, written to the shared folder for several uses."""
    return written(encode_corpus(docs, **how), "ids")

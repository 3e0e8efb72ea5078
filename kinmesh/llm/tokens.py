"""Problem 8: the whole corpus as ids of a public tokenizer.

Texts are split into the tokenizer's pre-tokens inside the JVM; each distinct pre-token is encoded once, in Arrow batches.
Pre-tokens that make up more than a HEAVY-th of the corpus number at most HEAVY; they and their ids go to all tasks, where
one vectorised lookup replaces them within the row of their document. What is rare leaves a numbered hole; the rare
pre-tokens alone, none of them hot, are joined with the word table by shuffle and put back into the holes of their row.

Defined edge cases: null and empty texts have the empty list; texts of any length are encoded whole; rows with a repeated or
null key are kept apart by a row number that is written once; strings of special tokens are ordinary text; columns other
than key and text are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.storage import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HEAVY = 20_000
#: Longer pre-tokens are joined however frequent they are, so that what goes to all tasks is at most HEAVY * LONGEST characters.
LONGEST = 64
#: The pattern by which the tokenizer splits text, once for each engine.
SPLIT_JVM = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=_ranks(path), special_tokens={})
        for b in batches:
            ids = [coder.encode_ordinary(w) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return encode


def split_words(text: str):
    """The pre-tokens of a text in order, null for null."""
    return F.regexp_extract_all(F.col(text), F.lit(SPLIT_JVM), F.lit(0))


def word_table(documents: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(word, n, ids): every distinct pre-token with its count and ids."""
    counted = documents.select(F.explode(split_words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(_encoder(vocabulary), "word string, n bigint, ids array<int>")


def _looker(words: list[str], ids: list[list[int]], key: str):
    """Replaces known pre-tokens by their ids; the j-th unknown one of a row leaves -j and is listed in `rare`."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        sizes = np.array([*map(len, ids), 1], np.int64)  # the last stands for a hole
        flat_ids = np.array([*(i for x in ids for i in x), 0], np.int32)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for b in batches:
            listed = b.column("words")
            flat = listed.flatten()
            at = pc.fill_null(pc.index_in(flat, known), len(words)).to_numpy(zero_copy_only=False)
            rows = listed.offsets.to_numpy().astype(np.int64) - listed.offsets[0].as_py()
            hole = at == len(words)
            holes = np.concatenate([[0], np.cumsum(hole)])
            long = sizes[at]
            behind = np.concatenate([[0], np.cumsum(long)])
            out = flat_ids[np.repeat(first[at] - behind[:-1], long) + np.arange(behind[-1])]
            where = np.flatnonzero(hole)
            row = np.searchsorted(rows, where, side="right") - 1
            out[behind[where]] = holes[rows[row]] - holes[where] - 1
            rare = pa.ListArray.from_arrays(pa.array(holes[rows], pa.int32()), flat.filter(pa.array(hole)))
            coded = pa.ListArray.from_arrays(pa.array(behind[rows], pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(key), coded, rare], names=[key, "ids", "rare"])

    return look


def _looked_up(documents: DataFrame, key: str, text: str, vocabulary: str) -> tuple[DataFrame, DataFrame]:
    """(row, key, ids with holes, rare) of every row, and the word table."""
    scratch = Scratch(documents.sparkSession, "words")
    coded = scratch.put(word_table(documents, text, vocabulary))
    total = coded.agg(F.sum("n").alias("total"))  # one row
    heavy = coded.crossJoin(F.broadcast(total)).where((F.col("n") * HEAVY > F.col("total")) & (F.length("word") <= LONGEST)).select("word", "ids").toPandas()  # at most HEAVY rows
    kind = documents.schema[key].dataType.simpleString()
    words = F.coalesce(split_words(text), F.array().cast("array<string>"))
    found = documents.select(F.col(key).alias("key"), words.alias("words")).mapInArrow(_looker(heavy.word.tolist(), [list(x) for x in heavy.ids], "key"), f"key {kind}, ids array<int>, rare array<string>")
    return scratch.put(found.withColumn("row", F.monotonically_increasing_id())), coded.select("word", "ids")


def encode(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every row's text."""
    rows, coded = _looked_up(documents, key, text, vocabulary)
    rare = rows.where(F.size("rare") > 0)
    fills = rare.select("row", F.posexplode("rare").alias("hole", "word")).join(coded.withColumnRenamed("ids", "fill"), "word")
    fills = fills.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("hole", "fill"))).alias("fills")).select("row", F.col("fills.fill").alias("fills"))
    whole = F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.get("fills", -x - 1))))
    filled = rare.select("row", "key", "ids").join(fills, "row").select("key", whole.alias("ids"))
    return rows.where(F.size("rare") == 0).select("key", "ids").unionByName(filled)


def lengths(documents: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): how many ids each text has, without making the lists."""
    rows, coded = _looked_up(documents, key, text, vocabulary)
    plain = F.size("ids") - F.size("rare")
    fills = rows.select("row", F.explode("rare").alias("word")).join(coded.select("word", F.size("ids").alias("fill")), "word").groupBy("row").agg(F.sum("fill").alias("fill"))
    return rows.select("row", "key", plain.alias("plain")).join(fills, "row", "left").select("key", (F.col("plain") + F.coalesce("fill", F.lit(0))).alias("tokens"))


def pieces(spark, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the vocabulary, 50,256 rows of a few bytes each."""
    return spark.createDataFrame([(i, bytearray(p)) for p, i in _ranks(vocabulary).items()], "id int, piece binary")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids); ids without a piece give a null text."""
    # one pass over the rows, so their numbers are read once only
    flat = coded.select(F.monotonically_increasing_id().alias("row"), "key", "ids").select("row", "key", F.posexplode_outer("ids").alias("pos", "id"))
    known = flat.join(F.broadcast(pieces(coded.sparkSession, vocabulary)), "id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("hex"))))).alias("parts")
    listed = known.groupBy("row", "key").agg(parts, F.count_if(F.col("pos").isNotNull() & F.col("piece").isNull()).alias("lost"))
    text = F.when(F.col("lost") == 0, F.decode(F.unhex(F.array_join("parts.hex", "")), "UTF-8"))
    return listed.select("key", text.alias("text"))

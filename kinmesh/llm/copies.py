"""Problem 7: records that differ in white space, case, punctuation or field order only.

Canonical records are range-partitioned and sorted by (key, sequence number), so that one key with a third of all rows is
spread over partitions, and adjacent rows are compared by their full keys. A run that touches the border of its partition
hands its key on; those few rows, two per partition at most, join the parts of a run that was split.

Sequence numbers are unique among different records. Defined edge cases: null equals empty; rows without any content are copies of each other; a null sequence number is kept as
a copy but is in no pair; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import squeezed, words
from kinmesh.storage import Scratch

_OUT = pa.schema([("rep", pa.int64()), ("seq", pa.int64()), ("border", pa.string())])


def canonical(plain: list[str], name: list[str] = (), anywhere: list[str] = ()) -> Column:
    """The full key of a record: fields by position, words of the name in any order, values of `anywhere` in any column."""
    parts = [squeezed(F.col(c)) for c in plain]
    if name:
        parts.append(F.array_join(F.array_sort(words(F.concat_ws(" ", *name))), ""))
    if anywhere:
        parts.append(F.array_join(F.array_sort(F.filter(F.array(*[squeezed(F.col(c)) for c in anywhere]), lambda x: x != "")), "\x1f"))
    return F.concat_ws("\x1e", *parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, seq) of a sorted partition; the first row of its first and last run also has the key."""
    key = rep = None
    first_out = True
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, seqs = batch.column("key"), batch.column("seq")
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(new.nonzero()[0] + 1).tolist()]
        same = key is not None and keys[0].as_py() == key
        reps, borders = [], [None] * batch.num_rows
        for i, (at, end) in enumerate(zip(starts, [*starts[1:], batch.num_rows])):
            if i or not same:
                rep = seqs[at].as_py()
            reps.extend([rep] * (end - at))
        if first_out:
            borders[0] = keys[0].as_py()
            first_out = False
        key = keys[batch.num_rows - 1].as_py()
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), seqs, pa.array(borders, pa.string())], schema=_OUT)
    if key is not None:  # the last run, named once more without a member
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([None], pa.int64()), pa.array([key])], schema=_OUT)


def runs(df: DataFrame, seq: str, key: Column, partitions: int | None = None) -> DataFrame:
    """(rep, seq): every row with the smallest sequence number among its copies."""
    keyed = df.select(key.alias("key"), F.coalesce(F.col(seq).cast("bigint"), -1 - F.monotonically_increasing_id()).alias("seq"))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(n, "key", "seq").sortWithinPartitions("key", "seq")
    found = Scratch(df.sparkSession, "copies").put(ordered.mapInArrow(_scan, "rep bigint, seq bigint, border string"))
    # at most two rows a partition, so their number is bounded by the number of partitions
    heads = found.where("border is not null").select("rep", "border")
    whole = heads.groupBy("border").agg(F.min("rep").alias("whole"))
    moved = heads.join(whole, "border").where("rep != whole").groupBy("rep").agg(F.min("whole").alias("whole"))
    return found.where("seq is not null").join(F.broadcast(moved), "rep", "left").select(F.coalesce("whole", "rep").alias("rep"), "seq")


def pairs(members: DataFrame) -> DataFrame:
    """(a_seq, b_seq) of all copies, smaller first. Its size is that of the result asked for, not of the search."""
    members = members.where("seq >= 0")
    several = members.groupBy("rep").count().where("count > 1").select("rep")
    members = members.join(several, "rep", "left_semi")
    a = members.select("rep", F.col("seq").alias("a_seq"))
    return a.join(members.select("rep", F.col("seq").alias("b_seq")), "rep").where("a_seq < b_seq").select("a_seq", "b_seq")

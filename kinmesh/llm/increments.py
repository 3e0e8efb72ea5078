"""Problem 2: each new batch against everything delivered before, without going through the history again.

A record becomes a set of features (field values, identifying ones counted more than once). ROWS x BANDS minwise hashes of
the set make BANDS band keys, and one bit of each hash makes a signature. History is the index on shared storage: the band
keys with their signatures in buckets by a hash of the key, and the fields of every content in buckets by its digest. A batch

1. is reduced to its contents; those the index has are known by digest and not added again,
2. appends the keys and fields of the others,
3. meets, bucket by bucket, what shares a band with it: the index is read where it lies and never shuffled, and a small
   batch reads the buckets of its own keys only,
4. verifies by the signatures' estimate of similarity, then by the fields.

Skew: rows alike to the letter are one content before anything is joined, and values that many people share are no
features. In a band with more than HOT contents each is compared with the earliest one first, and only those that are
not settled by it meet the others, so a hot group of near copies costs about one comparison a row; nothing is dropped.

Identity: a content is its 128-bit digest; buckets and pairs use its first half, and what two contents with an equal half
have is verified by their fields like anything else.

Defined edge cases: rows without any feature have no key and no repeats; null times are not delivered; ties in time are no
repeats of each other; an empty batch or index gives an empty result; repeated deliveries of a batch change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm import person
from kinmesh.storage import Scratch, exists

BANDS, ROWS = 20, 3
#: Bits in which the signatures of similar sets may differ: 27 of 60 are an estimated similarity of 0.1.
APART = 27
ACCEPT = 5.5
HOT = 200
#: Batches of at most so many band keys name them in the scan, so that only their buckets are read.
NAMED = 4096
FIELDS = ["name", "nid", "dob", "phone", "mail", "addr", "city"]
#: How often a field's value counts in the set.
WEIGHTS = {"nid": 3, "mail": 2, "dob": 2, "phone": 2, "name": 2}


def features() -> Column:
    """Hashed features of a profile (fields, and s, a hash of its scope): weighted fields, name words and address words of four characters or more."""
    fixed = [F.when(F.col(f).isNotNull(), F.xxhash64(F.lit(f"{f}{i}"), F.col(f), F.col("s"))) for f, n in WEIGHTS.items() for i in range(n)]
    listed = lambda c, tag: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w) >= 4), lambda w: F.xxhash64(F.lit(tag), w, F.col("s")))
    return F.concat(F.array_compact(F.array(*fixed)), listed(F.col("name"), "w"), listed(F.col("addr"), "a"))


def _signer(bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    added = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = batch.column("features")
                flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = sets.offsets.to_numpy()[:-1].astype(np.int64) - sets.offsets[0].as_py()
                if not len(flat):
                    continue
                keys, signature = [], np.zeros(len(starts), np.uint64)
                for band in range(bands):
                    key = np.full(len(starts), np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15), np.uint64)
                    for j in range(band * rows, band * rows + rows):
                        h = flat * factors[j] + added[j]
                        h ^= h >> np.uint64(31)
                        least = np.minimum.reduceat(h * np.uint64(0xD6E8FEB86659FD93), starts)
                        signature |= ((least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(63)) << np.uint64(j % 64)
                        key = (key ^ least) * np.uint64(0xFF51AFD7ED558CCD)
                        key ^= key >> np.uint64(33)
                    keys.append(key.view(np.int64))
                every = np.stack(keys, axis=1).ravel()
                offsets = pa.array(np.arange(0, len(every) + 1, bands), pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.array(every))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), listed, pa.array(signature.view(np.int64))], names=["id", "asks", "bands", "sig"])

    return sign


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """(id, asks, band, sig) for each band of each non-empty set of (id bigint, asks boolean, features array<bigint>)."""
    signed = sets.where(F.size("features") > 0).select("id", "asks", "features").mapInArrow(_signer(bands, rows, seed), "id bigint, asks boolean, bands array<bigint>, sig bigint")
    return signed.select("id", "asks", "sig", F.explode("bands").alias("band"))


class History:
    """The index at `path`; buckets (fixed when it is made) should leave some 4 million keys in each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        spec = f"{self.path}/spec"
        if exists(spark, spec):
            buckets = spark.read.json(spec).first()["buckets"]
        else:
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.json(spec)
        self.buckets = buckets
        name = f"kinmesh_{md5(self.path.encode()).hexdigest()[:16]}"
        self.keys, self.records = f"{name}_keys", f"{name}_records"
        self._make(self.keys, "band bigint, id bigint, sig bigint, asks boolean, gen int", "band", "keys")
        fields = ", ".join(f"{f} string" for f in FIELDS)
        self._make(self.records, f"id bigint, twin bigint, scope string, at timestamp, gen int, {fields}", "id", "records")

    def _make(self, name: str, columns: str, by: str, folder: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")

    def forget(self) -> None:
        """Takes the index out of the session's catalog; its files stay."""
        for name in (self.keys, self.records):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _append(self, df: DataFrame, name: str, by: str) -> None:
        # one task a bucket, so that an append adds one file to each
        df.select(self.spark.table(name).columns).repartition(self.buckets, by).write.insertInto(name)

    def deliver(self, batch: DataFrame) -> DataFrame:
        """(id, before): the records of `batch` that ask and have an earlier delivery of the same person in the same scope.

        batch: (id bigint, scope, at timestamp, asks boolean, fields); its contents are in the index afterwards. `before` is
        the time of an earlier delivery. Batches must come in order of time; records of one batch count for each other.
        """
        spark, scratch = self.spark, Scratch(self.spark, "delivery")
        said = F.col("nid").isNotNull() | F.col("mail").isNotNull() | F.col("name").isNotNull() & F.coalesce("dob", "phone", "addr").isNotNull()
        content = [F.struct(F.col(f).isNull(), F.col(f)) for f in FIELDS]
        rows = batch.where("at is not null").withColumns({"d1": F.xxhash64("scope", *content), "d2": F.xxhash64(F.lit(1), *content[::-1], "scope")})
        classes = rows.groupBy("d1", "d2").agg(F.first("scope").alias("scope"), F.min("at").alias("at"), F.max("asks").alias("asks"), *[F.first(f).alias(f) for f in FIELDS])
        index = spark.table(self.records)
        gen = (index.agg(F.max("gen")).first()[0] or 0) + 1
        old = index.select(F.col("id").alias("d1"), F.col("twin").alias("d2"), F.col("at").alias("known"))
        classes = scratch.put(classes.join(old, ["d1", "d2"], "left"))
        # twin is d2; what is known by digest isn't added again
        new = classes.where("known is null").withColumns({"id": F.col("d1"), "twin": F.col("d2"), "gen": F.lit(gen)})
        self._append(new, self.records, "id")
        keyed = band_keys(new.withColumn("s", F.xxhash64("scope")).select("id", "asks", features().alias("features"))).withColumn("gen", F.lit(gen))
        self._append(keyed, self.keys, "band")
        for name in (self.keys, self.records):
            spark.catalog.refreshTable(name)
        near = self._near(scratch, gen)
        own = classes.where("asks").select("d1", "d2", F.when(said, F.least("at", "known")).alias("own"))
        earliest = own.join(near, ["d1", "d2"], "left").select("d1", "d2", F.least("own", "other").alias("before")).where("before is not null")
        found = rows.where("asks").select("id", "d1", "d2", "at").join(earliest, ["d1", "d2"]).where("before < at").select("id", "before")
        kept = Scratch(spark, "repeats").put(found)
        scratch.sweep()
        return kept

    def _near(self, scratch: Scratch, gen: int) -> DataFrame:
        """(d1, d2, other): the earliest time of a verified partner of each asking content of generation `gen`."""
        every = self.spark.table(self.keys)
        asking = every.where((F.col("gen") == gen) & F.col("asks"))
        some = [r.band for r in asking.select("band").limit(NAMED + 1).collect()]  # at most NAMED + 1 numbers
        if len(some) <= NAMED:
            every = every.where(F.col("band").isin(some)) if some else every.where("false")
            asking = every.where((F.col("gen") == gen) & F.col("asks"))
        # which way a band is joined changes no result, so a sixteenth of the contents, by their ids, tells the hot ones
        some = every.where(F.pmod("id", F.lit(16)) == 0)
        hot = scratch.put(some.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT // 16).select("band"))
        close = F.bit_count(F.col("sig").bitwiseXOR(F.col("b_sig"))) <= APART
        other = lambda df: df.select("band", F.col("id").alias("b"), F.col("sig").alias("b_sig"))
        pair = lambda x, y: x.join(y, "band").where((F.col("id") != F.col("b")) & close).select(F.col("id").alias("a"), "b").distinct()
        near = self._verified(pair(asking.join(hot, "band", "left_anti"), other(every)))
        if not hot.isEmpty():
            at = self.spark.table(self.records).select("id", F.unix_micros("at").alias("at"))
            hot_asking = asking.join(hot, "band", "left_semi")
            hot_every = scratch.put(every.join(hot, "band", "left_semi").join(at, "id"))
            first = hot_every.groupBy("band").agg(F.min_by(F.struct(F.col("id").alias("b"), F.col("sig").alias("b_sig")), F.struct("at", "id")).alias("f")).select("band", "f.*")
            settled = scratch.put(self._verified(pair(hot_asking, first)))
            open_ = hot_asking.join(settled.select(F.col("d1").alias("id")), "id", "left_anti")
            near = near.unionByName(settled).unionByName(self._verified(pair(open_, other(hot_every))))
        return near.groupBy("d1", "d2").agg(F.min("other").alias("other"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """(d1, d2, other) of pairs (a, b) that are one person in one scope; other is the time of b."""
        side = lambda p: self.spark.table(self.records).select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "twin", "scope", "at", *FIELDS)])
        both = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
        good = both.where("a_scope = b_scope").where(person.same_person("a_", "b_") >= ACCEPT)
        return good.groupBy(F.col("a_id").alias("d1"), F.col("a_twin").alias("d2")).agg(F.min("b_at").alias("other"))

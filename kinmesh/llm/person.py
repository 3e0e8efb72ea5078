"""Person records brought to comparable form; the common ground of problems 2 and 6.

Every field is reduced to what survives spelling: sorted name words, bare identifiers, eight date digits, the last seven
digits of a phone, the local part of a mail address, the words of an address. Values that stand for nothing (placeholders)
are null. Values that many different people share are found by counting over all rows, never by a list: a phone's or mail
address's short form gives way to the whole one where it is shared, and to null where that is shared too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.common import NOISE, label, words
from kinmesh.llm.survivor import usable_phone
from kinmesh.storage import Scratch

#: A phone, mail address or identifier identifies nobody if none of its holders has one in so many of its records.
HOLDERS = 20
#: A date of birth that is so many times as frequent as dates are on average stands for an unknown one.
STAND_IN = 50


def profile(df: DataFrame, *keep: str) -> DataFrame:
    """`keep`, src and the comparable fields name, nid, dob, phone, mail, addr, city of customer records.

    phone_whole and mail_whole are the number and the address that phone and mail are cut from. Every stage is a projection
    of its own, so that no expression is computed twice.
    """
    up = df.select(
        *keep, label(F.col("source_system")).alias("src"), F.array_join(F.array_sort(words(F.col("name_norm"))), " ").alias("name"),
        F.regexp_replace(F.upper("natid_norm"), "[^A-Z0-9]", "").alias("nid"), F.regexp_replace("dob_norm", r"\D", "").alias("dob"),
        usable_phone(F.col("phone_norm")).alias("phone_whole"), F.regexp_replace(F.lower("email_norm"), r"[<>;\s]", "").alias("mail_whole"),
        F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.upper("address_norm"), NOISE, " ")), " ")), " ").alias("addr"),
        F.regexp_replace(F.upper("city_norm"), NOISE, "").alias("city"),
    )
    up = up.withColumn("mail_whole", F.when(F.instr("mail_whole", "@") > 3, F.col("mail_whole")))
    none = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return up.select(
        *keep, "src", none("name"), F.when(F.length("nid").between(6, 20) & F.col("nid").rlike(r"\d{5}"), F.col("nid")).alias("nid"),
        F.when((F.length("dob") == 8) & F.left("dob", F.lit(2)).isin("19", "20"), F.col("dob")).alias("dob"), F.right("phone_whole", F.lit(7)).alias("phone"),
        F.regexp_replace(F.substring_index("mail_whole", "@", 1), r"[^\p{L}\p{N}]", "").alias("mail"), F.when(F.length("addr") >= 5, F.col("addr")).alias("addr"),
        none("city"), "phone_whole", "mail_whole",
    )


def prepared(customers: DataFrame, *keep: str) -> DataFrame:
    """Profiles of customer records without shared values, written once, as every use reads them several times."""
    scratch = Scratch(customers.sparkSession, "profiles")
    first = scratch.put(profile(customers, *keep))
    out = scratch.put(without_shared(first))
    scratch.drop(first)
    return out


#: Fields whose shared values are dropped, and what the whole value of each is.
SHAREABLE = {"phone": "phone_whole", "mail": "mail_whole", "nid": "nid"}


def _shared(held: DataFrame, column: str) -> DataFrame:
    """(field, value): values of `column` of whose records no person has one in HOLDERS; held: (field, short, whole, who)."""
    each = held.groupBy("field", column, "who").agg(F.count(F.lit(1)).alias("n"))
    both = each.groupBy("field", column).agg(F.max("n").alias("most"), F.sum("n").alias("every"))
    return both.where(F.col("most") * HOLDERS < F.col("every")).select("field", F.col(column).alias("value"))


def without_shared(profiles: DataFrame) -> DataFrame:
    """Profiles with phones, mail addresses and identifiers that many share made whole or null; no row is lost.

    A person is a birth date, else an identifier or name. A shared value has more than HOLDERS records, so values are
    counted by hash first and only the holders of frequent ones are looked at; what is shared is decided by whole values.
    The tables of shared values are written, so that their joins are planned by their true size.
    """
    who = {f: F.coalesce(*[F.col(c) for c in ("dob", "nid", "name") if c != f]) for f in SHAREABLE}
    long = lambda *more: F.explode(F.array_compact(F.array(*[F.when(F.col(f).isNotNull() & who[f].isNotNull(), F.struct(F.lit(f).alias("field"), F.xxhash64(F.lit(f), f).alias("h"), *[x(f) for x in more])) for f in SHAREABLE]))).alias("v")
    often = profiles.select(long()).groupBy("v.h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOLDERS).select("h")
    scratch = Scratch(profiles.sparkSession, "shared")
    often = scratch.put(often)
    held = profiles.select(long(lambda f: F.col(f).alias("short"), lambda f: F.col(SHAREABLE[f]).alias("whole"), lambda f: who[f].alias("who"))).select("v.*")
    held = scratch.put(held.join(often, "h", "left_semi").drop("h"))
    short = scratch.put(_shared(held, "short"))
    whole = scratch.put(_shared(held.join(short.withColumnRenamed("value", "short"), ["field", "short"], "left_semi"), "whole"))
    for f, w in SHAREABLE.items():
        bad = short.where(F.col("field") == f).select(F.col("value").alias(f), F.lit(True).alias("__shared"))
        profiles = profiles.join(bad, f, "left")
        if w != f:
            lost = whole.where(F.col("field") == f).select(F.col("value").alias(w), F.lit(True).alias("__lost"))
            profiles = profiles.join(lost, w, "left").withColumn(f, F.when(F.col("__shared").isNull(), F.col(f)).when(F.col("__lost").isNull(), F.col(w))).drop("__lost")
        else:
            profiles = profiles.withColumn(f, F.when(F.col("__shared").isNull(), F.col(f)))
        profiles = profiles.drop("__shared")
    dates = profiles.where("dob is not null").groupBy("dob").agg(F.count(F.lit(1)).alias("n"))
    mean = dates.agg((F.sum("n") / F.count(F.lit(1))).alias("mean"))  # one row
    odd = scratch.put(dates.crossJoin(F.broadcast(mean)).where(F.col("n") > STAND_IN * F.col("mean")).select("dob", F.lit(True).alias("__odd")))
    profiles = profiles.join(odd, "dob", "left").withColumn("dob", F.when(F.col("__odd").isNull(), F.col("dob"))).drop("__odd")
    return profiles.drop("phone_whole", "mail_whole")


def _near(a: Column, b: Column, most: int) -> Column:
    return F.levenshtein(a, b, most) >= 0


def same_person(a: str, b: str) -> Column:
    """Points for and against two profiles (column prefixes a and b) being one person; 0 without any common field."""
    f = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))

    def points(n: str, equal: float, near: float, differ: float, most: int) -> Column:
        x, y = f(n)
        return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, equal).when(_near(x, y, most), near).otherwise(differ)

    x, y = f("name")
    name = F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 3.0).when(_near(x, y, 2), 2.0).when(_fits(x, y), 1.5).otherwise(-4.0)
    dx, dy = f("dob")
    apart = F.abs(F.left(dx, F.lit(4)).cast("int") - F.left(dy, F.lit(4)).cast("int"))
    # the first of January often stands for an unknown day; one digit of the year apart is rather a parent than an error
    rough = (apart == 0) & (_near(dx, dy, 2) | dx.endswith("0101") | dy.endswith("0101")) | (apart == 1) & (F.right(dx, F.lit(4)) == F.right(dy, F.lit(4)))
    dob = F.when(dx.isNull() | dy.isNull(), 0.0).when(dx == dy, 3.0).when(rough, 1.0).when(_near(dx, dy, 1), -1.0).otherwise(-3.0)
    mx, my = f("mail")
    bare = lambda c: F.regexp_replace(c, r"\D", "")
    mail = F.when(mx.isNull() | my.isNull(), 0.0).when(mx == my, 4.0).when(_near(mx, my, 2), F.when(bare(mx) == bare(my), 2.0).otherwise(0.0)).otherwise(-4.0)
    return (
        points("nid", 7.0, 3.0, -6.0, 2) + dob + mail + points("phone", 2.5, 1.0, -1.0, 1)
        + points("addr", 1.5, 1.0, -0.5, 3) + points("city", 0.5, 0.5, -0.5, 2) + name
    )


def _fits(x: Column, y: Column) -> Column:
    """Whether each word of the shorter name has a partner in the other; an initial stands for a name that begins with it."""
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    partner = lambda w, v: (v == w) | (F.length(w).isin(1, 3) & v.startswith(w)) | ((F.length(w) > 3) & (F.levenshtein(v, w, 2) >= 0))
    return F.forall(F.split(shorter, " "), lambda w: F.exists(F.split(longer, " "), lambda v: partner(w, v)))


def contradict(a: str, b: str) -> Column:
    """Whether written names or birth dates of two profiles (column prefixes a and b) speak of different people.

    Names contradict if a word of one has no partner in the other, dates if they differ in more than one digit, an exchanged
    day and month or an unknown day. One of the two may, if identifiers or mail addresses are equal; null never does.
    """
    f = lambda n: (F.col(f"{a}{n}"), F.col(f"{b}{n}"))
    x, y = f("name")
    name = F.when(x.isNull() | y.isNull() | (x == y), False).when(_near(x, y, 2), False).otherwise(~_fits(x, y))
    dx, dy = f("dob")
    apart = F.abs(F.left(dx, F.lit(4)).cast("int") - F.left(dy, F.lit(4)).cast("int"))
    exchanged = (F.left(dx, F.lit(4)) == F.left(dy, F.lit(4))) & (F.substring(dx, 5, 2) == F.right(dy, F.lit(2))) & (F.substring(dy, 5, 2) == F.right(dx, F.lit(2)))
    unknown = (apart == 0) & (_near(dx, dy, 2) | dx.endswith("0101") | dy.endswith("0101")) | (apart == 1) & (F.right(dx, F.lit(4)) == F.right(dy, F.lit(4)))
    # a generation apart is rather a parent of the same name than an error
    dob = F.when(dx.isNull() | dy.isNull() | (dx == dy), False).otherwise(~(exchanged | unknown | _near(dx, dy, 1) & (apart < 15)))
    # one name with another number is another account; with another or no date of birth it is a namesake's
    mx, my = f("mail")
    bare = lambda c: F.regexp_replace(c, r"\d", "")
    namesake = F.coalesce((mx != my) & (bare(mx) == bare(my)), F.lit(False)) & ~F.coalesce(dx == dy, F.lit(False))
    strong = F.lit(False)
    for n in ("nid", "mail"):
        u, v = f(n)
        strong = strong | F.coalesce(u == v, F.lit(False))
    return F.when(strong, name & dob).otherwise(name | dob | namesake)

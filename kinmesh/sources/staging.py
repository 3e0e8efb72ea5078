"""Sources: staging files, header routing, demo rows, and records derived from the customer table."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.functions.text import some
from kinmesh.sources import workbook
from kinmesh.storage import exists

log = logging.getLogger(__name__)

# Header names, lower case without blanks and underscores.
FIRST = ["cusnmf", "firstname", "fname", "givenname", "mn", "first", "firstnm"]
LAST = ["cusnml", "lastname", "lname", "surname", "familyname", "last", "lastnm", "familynm"]
FULL = ["name", "fullname", "cusname", "customername", "entity", "company", "organization", "entityname", "partyname", "clientname", "companyname"]
SPARE = ["description", "desc", "label", "title", "remarks", "notes"]
# Parts of header names in the order of their priority.
ROUTES = [
    ("phone", ["phone", "mobile", "teleno", "moblno", "cell", "telxno"]), ("email", ["email", "mail"]), ("dob", ["dob", "birth"]), ("address", ["addr", "adrs", "street"]),
    ("city", ["city", "town"]), ("natid", ["natid", "ssid", "nationalid", "idnum", "nid", "natlid"]), ("source_customer_id", ["custid", "cuscod", "customerid", "accountno", "uscod"]),
]
METADATA = {"custyp": "cust_type", "cussts": "status", "gender": "gender", "oprbra": "branch", "sponam": "sponsor", "timstamp": "timestamp"}

FIELDS = ["source_customer_id", "source_system", "first_name", "last_name", "phone", "email", "dob", "address", "city", "natid"]

# Ten demo customers (customer_id, first_name, last_name, phone, email, dob, address, city, source_system).
DEMO = [
    ("CUST001", "John", "Smith", "555-123-4567", "john.smith@email.com", "1985-03-15", "123 Main Street, Apt 4B", "New York", "CORE_BANKING"),
    ("CUST002", "John", "Smyth", "5551234567", "jsmith@email.com", "1985-03-15", "123 Main St, Apt 4B", "New York", "LOANS"),
    ("CUST003", "Jane", "Doe", "555-987-6543", "jane.doe@gmail.com", "1990-07-22", "456 Oak Avenue", "Los Angeles", "CORE_BANKING"),
    ("CUST004", "Jane", "Doe", "555-987-6543", "jane.doe@gmail.com", "1990-07-22", "456 Oak Ave", "Los Angeles", "CARDS"),
    ("CUST005", "Robert", "Johnson", "555-456-7890", "robert.j@company.com", "1978-11-30", "789 Pine Road", "Chicago", "CORE_BANKING"),
    ("CUST006", "Bob", "Johnson", "555-456-7890", "bob.johnson@company.com", "1978-11-30", "789 Pine Rd", "Chicago", "INVESTMENTS"),
    ("CUST007", "Maria", "Garcia", "555-111-2222", "maria.garcia@email.com", "1995-02-14", "321 Elm Street", "Miami", "CORE_BANKING"),
    ("CUST008", "David", "Williams", "555-333-4444", "david.w@email.com", "1982-09-08", "654 Maple Drive", "Seattle", "CORE_BANKING"),
    ("CUST009", "D.", "Williams", "5553334444", "dwilliams@email.com", "1982-09-08", "654 Maple Dr", "Seattle", "CARDS"),
    ("CUST010", "Sarah", "Brown", "555-555-5555", "sarah.brown@email.com", "1988-12-25", "987 Cedar Lane", "Boston", "CORE_BANKING"),
]


def csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A staging file with header, every column a string; without an encoding UTF-8, and ISO-8859-1 if the file isn't that."""
    if encoding is None:
        broken = spark.read.text(path).where(~F.is_valid_utf8("value"))
        encoding = "UTF-8" if broken.isEmpty() else "ISO-8859-1"
    return spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of several places at which there is a file."""
    return next((p for p in paths if p and exists(spark, p)), None)


def staged(spark: SparkSession, *paths: str | None) -> DataFrame | None:
    """The staging file at the first of several places that has one; None if no place has or it can't be read."""
    path = first_existing(spark, *paths)
    try:
        return csv(spark, path) if path else None
    except Exception:
        log.warning("staging file %s can't be read", path, exc_info=True)
        return None


#: Kinds of files that can be uploaded.
UPLOADS = ("xls", "xlsx", "csv")


def upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded file as strings; ValueError for other kinds and for files without rows."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind not in UPLOADS:
        raise ValueError(f"a file of kind {kind} can't be read, only {', '.join(UPLOADS)}")
    return require_rows(csv(spark, path) if kind == "csv" else workbook.read(spark, path))


def records_or_fallback(spark: SparkSession, raw: DataFrame | None, *paths: str | None) -> DataFrame:
    """The given records; if there are none the staging file, and if that is missing or empty the demo customers."""
    for df in (lambda: raw, lambda: staged(spark, *paths)):
        found = df()
        if found is not None and not found.isEmpty():
            return found
    return demo(spark)


def stats(new: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row: staged records and records in all."""
    n = new.agg(F.count(F.lit(1)).alias("new_records"))
    total = known.agg(F.count(F.lit(1)).alias("known")) if known is not None else n.select(F.lit(0).alias("known"))
    return n.crossJoin(total).select("new_records", (F.col("new_records") + F.col("known")).alias("total_records"))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no input records")
    return df


def header(name: str) -> str:
    return name.lower().strip().replace("_", "").replace(" ", "")


def route(names: list[str]) -> dict[str, str]:
    """Target of each header: a field, a metadata field, or its own name in lower case with underscores."""
    out = {}
    for n in names:
        h = header(n)
        if h in FIRST:
            out[n] = "first_name"
        elif h in LAST:
            out[n] = "last_name"
        elif h in FULL:
            out[n] = "name"
        else:
            out[n] = next((t for t, parts in ROUTES if any(p in h for p in parts)), METADATA.get(h, n.lower().strip().replace(" ", "_")))
    return out


def _first(cols: list[Column]) -> Column:
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def name_of(first: Column, last: Column, full: Column, spare: Column) -> Column:
    """First and last name joined, else the full name, else a descriptive text."""
    joined = F.nullif(F.concat_ws(" ", some(first), some(last)), F.lit(""))
    return F.coalesce(joined, some(full), some(spare))


def name_fallback(name: Column, email: Column, phone: Column, customer: Column, natid: Column, others: list[Column] = ()) -> Column:
    """A stand-in for a missing name: mail, phone, numbers, and at last any text of more than two characters."""
    nonempty = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(name, F.substring_index(nonempty(email), "@", 1), F.concat(F.lit("Phone: "), nonempty(phone)), F.concat(F.lit("ID: "), nonempty(customer)), F.concat(F.lit("NID: "), nonempty(natid)), *[F.when(F.length(c) > 2, c) for c in others])


def mapped(df: DataFrame) -> DataFrame:
    """A staging frame of any headers as records with name, phone, email, dob, address, city, natid, source_customer_id.

    Rows without a name or any stand-in for one are dropped. Headers are resolved on the driver, values in one projection.
    """
    to = route(df.columns)
    by: dict[str, list[str]] = {}
    for n, t in to.items():
        by.setdefault(t, []).append(n)
    cols = lambda t: [some(F.col(f"`{n}`")) for n in by.get(t, [])]
    # a later column overwrites an earlier one; mobile numbers go before other phones
    latest = lambda t: _first(cols(t)[::-1])
    spare = _first([some(F.col(f"`{n}`")) for n in df.columns if header(n) in SPARE])
    fuzzy = [n for n in df.columns if "name" in header(n) and to[n] not in ("first_name", "last_name", "name") and not any(x in header(n) for x in ("file", "date", "user", "branch"))]
    full = F.coalesce(latest("name"), *[some(F.col(f"`{n}`")) for n in fuzzy[:1]])
    phones = sorted(by.get("phone", []), key=lambda n: "mob" not in header(n))
    parts = sorted(by.get("address", []), key=lambda n: "1" not in header(n))
    address = F.nullif(F.concat_ws(" ", *[some(F.col(f"`{n}`")) for n in parts]), F.lit("")) if parts else F.lit(None).cast("string")
    found = {"phone": _first([some(F.col(f"`{n}`")) for n in phones]), "email": latest("email"), "dob": latest("dob"), "address": address, "city": latest("city"), "natid": latest("natid"), "source_customer_id": latest("source_customer_id")}
    name = name_fallback(name_of(latest("first_name"), latest("last_name"), full, spare), found["email"], found["phone"], found["source_customer_id"], found["natid"], [*(found[f] for f in ("dob", "address", "city")), *(some(F.col(f"`{n}`")) for n in df.columns if df.schema[n].dataType.simpleString() == "string")])
    meta = [_first(cols(m)).alias(m) for m in METADATA.values()] + [_first([some(F.col(f"`{n}`")) for n in phones if ("mob" in header(n)) == mobile]).alias(name_) for name_, mobile in (("mobile", True), ("landline", False))]
    keep = [F.col(f"`{n}`") for n in df.columns if n.lower() in ("ingest_seq", "source_system")]
    return df.select(*keep, name.alias("name"), *[c.alias(t) for t, c in found.items()], F.struct(*meta).alias("metadata")).where("name is not null")


def records_from_customer(customer: DataFrame) -> DataFrame:
    """Noisy variants of people, three consecutive customers being one identity (true_ident)."""
    from kinmesh.plans.sql import SOURCE

    return customer.sparkSession.sql("WITH " + SOURCE.replace("FROM customer", "FROM {customer}").replace("{customer}", "{c}") + " SELECT * FROM src", c=customer)


def demo(spark: SparkSession) -> DataFrame:
    """The ten demo customers as raw records; their sequence number is their place."""
    names = ["source_customer_id", "first_name", "last_name", "phone", "email", "dob", "address", "city", "source_system"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(DEMO, 1)], "ingest_seq bigint, " + ", ".join(f"{n} string" for n in names))
    return df.withColumn("natid", F.lit(None).cast("string"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

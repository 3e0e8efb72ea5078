"""Raw records to normalized customers: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.functions import text as t
from kinmesh.sources.staging import name_of

# Names under which raw records hold a field, in the order in which they are looked up.
ALIASES = {
    "first_name": ["first_name", "CUSNMF", "fname"], "last_name": ["last_name", "CUSNML", "lname"], "name": ["name"], "phone": ["phone", "mobile", "telephone"], "email": ["email", "MAILID"],
    "dob": ["dob", "date_of_birth", "CUSDOB"], "address": ["address", "ADDRS1"], "city": ["city", "CITYNM"], "natid": ["natid", "national_id", "NATLID"], "source_system": ["source_system", "SOURCE_SYSTEM"],
    "source_customer_id": ["customer_id", "id", "source_customer_id", "CUSCOD", "USCOD"],
    "cust_type": ["cust_type", "CUSTYP"], "status": ["status", "CUSSTS"], "gender": ["gender", "GENDER"], "branch": ["branch", "OPRBRA"], "sponsor": ["sponsor", "SPONAM"], "timestamp": ["timestamp", "TIMSTAMP"], "mobile": ["MOBLNO"], "landline": ["TELENO"],
}
HASHED = ["name_norm", "phone_norm", "email_norm", "dob_norm", "address_norm", "natid_norm"]
META = ["cust_type", "status", "gender", "branch", "sponsor", "timestamp", "mobile", "landline"]


def normalize(raw: DataFrame, default_source: str = "LEGACY_SYSTEM") -> DataFrame:
    """Adds the normalized fields, customer_key and record_hash; raw has the fields under any of ALIASES.

    The first name of a list that a record has a value under counts. Phones fall back from one column to the next when they
    are no phones. A struct `metadata` counts where raw has no such column itself.
    """
    have = set(raw.columns)
    packed = raw.schema["metadata"].dataType.names if "metadata" in have and hasattr(raw.schema["metadata"].dataType, "names") else []

    def held(n: str) -> list:
        found = [F.col(f"`{a}`") for a in ALIASES[n] if a in have]
        return found or ([F.col(f"metadata.`{n}`")] if n in packed else [])

    def col(n: str):
        return F.coalesce(*[t.some(c) for c in held(n)]) if held(n) else F.lit(None).cast("string")

    phones = [t.normalize_phone(t.some(F.col(f"`{a}`"))) for a in [*ALIASES["phone"], "MOBLNO", "TELENO"] if a in have]
    full = name_of(col("first_name"), col("last_name"), col("name"), F.lit(None).cast("string"))
    fields = {
        "name_norm": t.normalize_name(full), "phone_norm": F.coalesce(*phones) if phones else F.lit(None).cast("string"), "email_norm": t.normalize_email(col("email")), "dob_norm": t.normalize_dob(col("dob")),
        "address_norm": t.normalize_address(col("address")), "city_norm": t.normalize_name(col("city")), "natid_norm": t.normalize_natid(col("natid")),
    }
    source = F.coalesce(col("source_system"), F.lit(default_source))
    key = F.sha2(F.concat_ws("|", source, F.coalesce(col("source_customer_id"), F.lit("")), F.col("ingest_seq").cast("string")), 256)
    extra = [F.col(c) for c in ("true_ident",) if c in have]
    meta = F.struct(*[col(m).alias(m) for m in META]).alias("metadata")
    out = raw.select(key.alias("customer_key"), "ingest_seq", col("source_customer_id").alias("source_customer_id"), source.alias("source_system"), *extra, *[c.alias(n) for n, c in fields.items()], meta)
    return out.withColumn("record_hash", t.record_hash(*[F.col(c) for c in HASHED]))

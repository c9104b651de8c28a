"""Stores: encrypted mappings with expiry, session state, local resources with checksums."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 43


class StoreError(ValueError):
    """A mapping cannot be opened: wrong key, expired or damaged."""


def key_id(key: bytes) -> str:
    return hashlib.sha256(b"mapping-key\0" + key).hexdigest()[:16]


def seal(df: DataFrame, ident: str, mapping: str, key: bytes, created: int, ttl: int, salt: str = "") -> DataFrame:
    """(id, key_id, created_at, expires_at, payload): mappings as JSON under AES-256-GCM.

    The header and the id are authenticated with the payload. The nonce is derived from id, creation time and content, so a
    repeated task writes the same bytes and no nonce meets two contents.
    """
    head = F.concat_ws("|", F.lit(key_id(key)), F.lit(str(created)), F.lit(str(created + ttl)), F.col(ident).cast("string"))
    plain = F.to_json(F.col(mapping))
    iv = F.unhex(F.substring(F.sha2(F.encode(F.concat_ws("\0", head, F.lit(salt), plain), "UTF-8"), 256), 1, 24))
    sealed = F.call_function("aes_encrypt", F.encode(plain, "UTF-8"), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode(head, "UTF-8"))
    return df.select(F.col(ident).cast("string").alias("id"), F.lit(key_id(key)).alias("key_id"), F.lit(created).alias("created_at"), F.lit(created + ttl).alias("expires_at"), sealed.alias("payload"))


def unseal(store: DataFrame, key: bytes, now: int) -> DataFrame:
    """(id, mapping) of entries of this key that have not expired; a changed header or payload makes the row fail."""
    head = F.concat_ws("|", "key_id", F.col("created_at").cast("string"), F.col("expires_at").cast("string"), "id")
    plain = F.call_function("aes_decrypt", F.col("payload"), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), F.encode(head, "UTF-8"))
    return store.where((F.col("key_id") == key_id(key)) & (F.col("expires_at") >= now)).select("id", F.from_json(F.decode(plain, "UTF-8"), "map<string,string>").alias("mapping"))


def entries(store: DataFrame) -> DataFrame:
    """What a store holds, without opening anything."""
    return store.select("id", "key_id", "created_at", "expires_at", F.octet_length("payload").alias("bytes")).orderBy("id")


def purge(store: DataFrame, now: int) -> DataFrame:
    return store.where(F.col("expires_at") >= now)


def delete(store: DataFrame, ids: list[str]) -> DataFrame:
    return store.where(~F.col("id").isin(*ids))


SESSION = "struct<version:int,nonce:string,counters:map<string,int>,mapping:map<string,string>,original_to_placeholder:map<string,string>>"


def session_json(df: DataFrame, nonce: str, counters: str, mapping: str, surfaces: str) -> DataFrame:
    """`df` with `state`: a session as JSON, version 1."""
    return df.withColumn("state", F.to_json(F.struct(F.lit(1).alias("version"), F.col(nonce).alias("nonce"), F.col(counters).alias("counters"), F.col(mapping).alias("mapping"), F.col(surfaces).alias("original_to_placeholder"))))


def session_from_json(df: DataFrame, state: str = "state") -> DataFrame:
    """`df` with `session`, and `error` where the state is of another version or unreadable."""
    s = F.from_json(F.col(state), SESSION)
    return df.withColumn("session", s).withColumn("error", F.when(s["version"].isNull() | (s["version"] != 1), "unsupported session state"))


class Resources:
    """Local resource files listed in a manifest with SHA-256; nothing is fetched from a network."""

    def __init__(self, spark: SparkSession, folder: str, manifest: str = "manifest.json"):
        self.folder = Path(folder)
        schema = "kind string, name string, languages array<string>, file string, sha256 string, size bigint"
        self.rows = spark.read.schema(schema).json(str(self.folder / manifest), multiLine=True)

    def path(self, kind: str, name: str) -> str:
        row = self.rows.where((F.col("kind") == kind) & (F.col("name") == name)).first()
        if row is None:
            raise StoreError(f"no {kind} named {name!r}")
        file = self.folder / row["file"]
        if hashlib.sha256(file.read_bytes()).hexdigest() != row["sha256"]:
            raise StoreError(f"{file.name} is damaged")
        return str(file)

    def best_gazetteers(self) -> DataFrame:
        """Of each name the file for the fewest languages, then the largest."""
        from pyspark.sql.window import Window

        order = Window.partitionBy("name").orderBy(F.size("languages"), F.desc("size"))
        return self.rows.where("kind = 'gazetteer'").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

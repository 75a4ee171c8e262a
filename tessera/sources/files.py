"""Files: parquet tables, folder listings, JSON pages of providers, list addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of audio files.
AUDIO = ["aac", "aiff", "ape", "flac", "m4a", "mp3", "mp4", "ogg", "opus", "wav", "wv"]

#: Provider pages.
GROUPS = "count int, offset int, `release-groups` array<struct<id:string,title:string,`artist-credit`:array<struct<name:string,joinphrase:string>>,`first-release-date`:string,`primary-type`:string,`secondary-types`:array<string>,disambiguation:string,score:int>>"
EDITIONS = "`release-count` int, `release-offset` int, releases array<struct<id:string,title:string,date:string,country:string,status:string,disambiguation:string,barcode:string,media:array<struct<format:string,`track-count`:int>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listing(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, size, modified) of files under a folder, without reading them."""
    pattern = "*.{" + ",".join(extensions or AUDIO) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def provider_pages(spark: SparkSession, path: str, schema: str = GROUPS) -> DataFrame:
    """JSON pages, one a file, with complete: nothing lies beyond them."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def group_items(pages: DataFrame) -> DataFrame:
    """One row a release group of the pages, with its credit text and whether its page was the last."""
    items = F.col("release-groups")
    complete = F.col("offset") + F.size(items) >= F.col("count")
    rows = pages.select(complete.alias("complete"), F.posexplode(items).alias("ordinal", "g"))
    credit = F.aggregate(F.col("g.artist-credit"), F.lit(""), lambda t, c: F.concat(t, c["name"], F.coalesce(c["joinphrase"], F.lit(""))))
    return rows.select("complete", "ordinal", F.col("g.id").alias("id"), F.col("g.title").alias("title"), credit.alias("artist"), F.col("g.first-release-date").alias("date"), F.col("g.primary-type").alias("primary_type"))


def list_id(address: Column, host: str, scheme: str) -> Column:
    """The id in a list's address, a bare id, or null: https://host/[intl-xx/]playlist/ID or scheme:playlist:ID; ids are 22 letters and digits."""
    t = F.trim(address)
    quoted = host.replace(".", r"\.")
    found = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"^([A-Za-z0-9]{22})$", rf"^{scheme}:playlist:([A-Za-z0-9]{{22}})$", rf"^https://{quoted}/+(?:intl-[^/?#]*/+)?playlist/+([A-Za-z0-9]{{22}})/*(?:[?#].*)?$")])
    return found


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

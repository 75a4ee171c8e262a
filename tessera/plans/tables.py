"""The catalogue's tables derived from the sales tables, once for Spark and once as SQL for the oracle.

An order is an album, its distinct lines are tracks, parts give titles and genres, suppliers are the credited
artists and the customer is the album's artist. Shipped lines are saved, returned ones available.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.browse import Catalogue
from tessera.sources.files import table


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        return self["lineitem"].groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("pk"), F.sum("l_quantity").alias("qty"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_shipdate").alias("shipped"), F.count("*").alias("copies"))

    @cached_property
    def tracks(self) -> DataFrame:
        return self.titled(self.lines)

    def titled(self, lines: DataFrame) -> DataFrame:
        """lines as tracks, with what their parts give; columns that lines has been selected without are left out."""
        rest = [c for c in ("qty", "flag", "status", "shipped", "copies") if c in lines.columns]
        return lines.join(self["part"].select(F.col("p_partkey").alias("pk"), "p_name", "p_type"), "pk").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"), F.col("l_orderkey").alias("album_id"), F.col("p_name").alias("title"),
            F.expr("(l_linenumber - 1) div 4 + 1").cast("int").alias("disc"), F.col("l_linenumber").alias("number"), F.col("p_type").alias("genre"), *rest)

    @cached_property
    def albums(self) -> DataFrame:
        return self["orders"].join(self["customer"], F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("album_id"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("artist_id"), F.col("c_name").alias("artist"))

    @cached_property
    def artists(self) -> DataFrame:
        return self["supplier"].select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"))

    @cached_property
    def credits(self) -> DataFrame:
        return self["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("track_id"), F.col("l_suppkey").alias("artist_id")).distinct()

    @cached_property
    def saved(self) -> DataFrame:
        return self.tracks.where("status = 'F'").select("track_id")

    @cached_property
    def available(self) -> DataFrame:
        return self.tracks.where("flag = 'R'").select("track_id")

    @cached_property
    def hidden(self) -> DataFrame:
        return self["supplier"].where("s_acctbal < 0").select(F.col("s_suppkey").alias("artist_id"))

    @cached_property
    def ignored(self) -> DataFrame:
        return self.tracks.where("qty <= 3").select("track_id")

    @property
    def catalogue(self) -> Catalogue:
        return Catalogue(self.tracks, self.albums, self.artists, self.credits, self.saved, self.available, self.hidden, self.ignored)

    @cached_property
    def titles(self) -> DataFrame:
        """(id, a, b): page titles beside variants of them."""
        t = F.regexp_extract("html", "<title>(.*?)</title>", 1)
        return self["pages"].select(F.col("page_id").alias("id"), t.alias("__t")).select("id", F.col("__t").alias("a"), variant(F.col("id") % 8).alias("b"))


#: SQL of the title variants, the same in both dialects.
VARIANTS = ["concat('[', __t, ']')", "concat(__t, ' (Live)')", "replace(__t, 'e', 'é')", "concat('  ', replace(__t, 'e', 'E'), '  ')", "concat(__t, ' EP')", "concat('The ', __t)", "replace(replace(__t, 't', 't‐'), '|', '&')"]


def variant(k: Column) -> Column:
    b = F.when(k == 0, F.col("__t"))
    for n, v in enumerate(VARIANTS, 1):
        b = b.when(k == n, F.expr(v))
    return b


PRELUDE = """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, sum(l_quantity) AS qty, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_shipdate) AS shipped, count(*) AS copies FROM lineitem GROUP BY 1, 2),
tracks AS (SELECT l_orderkey * 10 + l_linenumber AS track_id, l_orderkey AS album_id, p_name AS title, ((l_linenumber - 1) // 4 + 1)::INT AS disc, l_linenumber AS number, p_type AS genre, qty, flag, status, shipped, copies FROM l JOIN part ON p_partkey = pk),
albums AS (SELECT o_orderkey AS album_id, o_orderpriority || ' ' || c_mktsegment AS title, year(o_orderdate)::INT AS year, o_custkey AS artist_id, c_name AS artist FROM orders JOIN customer ON c_custkey = o_custkey),
artists AS (SELECT s_suppkey AS artist_id, s_name AS name FROM supplier),
credits AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS track_id, l_suppkey AS artist_id FROM lineitem),
saved AS (SELECT track_id FROM tracks WHERE status = 'F'),
available AS (SELECT track_id FROM tracks WHERE flag = 'R'),
hidden AS (SELECT s_suppkey AS artist_id FROM supplier WHERE s_acctbal < 0),
ignored AS (SELECT track_id FROM tracks WHERE qty <= 3),
visible AS (SELECT * FROM tracks WHERE track_id IN (SELECT track_id FROM saved) AND track_id NOT IN (SELECT track_id FROM ignored)
  AND track_id NOT IN (SELECT track_id FROM credits JOIN hidden USING (artist_id)))
"""

TITLES = "WITH p AS (SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS __t FROM pages), titles AS (SELECT id, __t AS a, CASE id % 8 WHEN 0 THEN __t " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(VARIANTS, 1)) + " END AS b FROM p)\n"

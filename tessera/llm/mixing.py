"""Mixing sources to target weights with hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)


def n_words(text: Column) -> Column:
    """Words of a text: runs of anything but space and the control characters 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. Together they get share of all
    sizes; a target stops at most times its source's size and the excess goes to the others by weight.
    That fixpoint is min(most * size, level * weight), and the level follows from prefix sums in the
    order in which sources reach their stop. The windows run over one row a source.
    """
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("stop", F.col("source_size") * most).withColumn("ratio", F.col("stop") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("ratio", F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    settled = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levels.withColumn("settled", settled).select("source", "source_size", F.when(F.col("level") <= F.col("ratio"), F.col("settled") * F.col("w")).otherwise(F.col("stop")).alias("target"))


def _takes(docs: DataFrame, id_col: str, source_col: str, text_col: str, apart: Column, weights: tuple[float, ...], share: float, most: float, rows_a_range: int) -> tuple[DataFrame, int]:
    """Groups of rows that the mix can't tell apart: equal id, source, size and `apart`, with n rows each.

    Checkpointed rows (id, source, size, apart, n, source_size, target, epochs, whole, part): every row is
    taken epochs times, whole of them once more and one more of them in part; and the greatest n.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), apart.alias("apart"), key.alias("key"))
    groups = cut(sized.groupBy("source", "key", "id", "size", "apart").agg(F.count("*").alias("n")))
    facts = groups.agg(F.count("*").alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    digits = 1
    while facts["rows"] / 16**digits > rows_a_range:
        digits += 1
    words = F.col("size") * F.col("n")
    ranged = groups.withColumn("range", F.substring("key", 1, digits))
    totals = ranged.groupBy("source", "range").agg(F.sum(words).alias("total"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(totals.groupBy("source").agg(F.sum("total").alias("source_size")), weights, share, most)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    offsets = offsets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "apart").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("upto", F.sum(words).over(inside)).join(
        offsets.select(F.col("source").alias("s"), F.col("range").alias("r"), "offset", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")),
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    left = F.greatest(F.lit(0), F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - (F.col("offset") + F.col("upto") - words))
    placed = placed.withColumn("epochs", epochs).withColumn("left", F.least(left, words))
    placed = placed.withColumn("whole", F.when(F.col("size") > 0, F.expr("left div size")).otherwise(F.lit(0)).cast("long"))
    return placed.select("id", "source", "size", "apart", "n", "source_size", "target", "epochs", "whole", (F.col("left") - F.col("whole") * F.col("size")).cast("long").alias("part")), facts["n"]


def _repeated(df: DataFrame, times: str, spread: bool, chunk: int = 10_000) -> DataFrame:
    """Each row as often as its column times says; with spread, many repeats of one row are dealt over tasks."""
    df = df.where(F.col(times) > 0).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(`{times}` - 1) div {chunk}"))))
    if spread:
        df = df.repartition(F.xxhash64(*df.columns))
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(chunk), F.col(times) - F.col("__chunk") * chunk)))).drop("__chunk", "__copy", times)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, rows_a_range: int = 50_000) -> DataFrame:
    """One row for each input row: id_col, source, size, source_size, target, taken (words, repeats counted).

    Rows of a source are put in the order of the md5 of their id (a null id counts as the empty
    text), then of their size; a source's budget is its target, rounded down. Whole epochs take every
    row; what is left of the budget takes rows in that order and part of the row at the cut, so each
    source takes its budget exactly. Rows equal in id, source and size are one group with a count, so a
    hot id is no long list; keys are split into equal ranges, each range sums its own sizes, and the
    ranges' totals give the offsets: a hot source is many ranges. Null and empty texts have size 0; very
    long texts count whole; empty tables give no rows; other columns aren't read.
    """
    takes, most_rows = _takes(docs, id_col, source_col, text_col, F.lit(0), weights, share, most, rows_a_range)
    base = F.col("epochs") * F.col("size")
    kinds = F.array(F.struct(F.col("whole").alias("rows"), (base + F.col("size")).alias("taken")), F.struct((F.col("part") > 0).cast("long").alias("rows"), (base + F.col("part")).alias("taken")), F.struct((F.col("n") - F.col("whole") - (F.col("part") > 0).cast("long")).alias("rows"), base.alias("taken")))
    each = takes.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.inline(kinds))
    return _repeated(each, "rows", most_rows > rows_a_range).withColumn("taken", F.col("taken").cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_a_range: int = 50_000) -> DataFrame:
    """docs as the mix takes them: a row for each whole repeat, and the first words of the row at its source's cut.

    Each source's rows hold its budget exactly. Of rows with equal id, source and text at a cut any may
    be the ones taken once more; their other columns then come from one of them. Documents without
    words go; a null id, source or other column stays null; empty tables give no rows.
    """
    takes, most_rows = _takes(docs, id_col, source_col, text_col, F.xxhash64(text_col), WEIGHTS, 1.5, 2.0, rows_a_range)
    some = (F.col("n") > 1) & (F.col("whole") < F.col("n")) & ((F.col("whole") > 0) | (F.col("part") > 0))
    takes = cut(takes.where("size > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("apart").alias("__apart"), "epochs", "whole", "part", "n", some.alias("some")))
    of_row = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.xxhash64(text_col) == F.col("__apart"))
    again = F.when(F.col("some"), 0).otherwise((F.col("whole") == F.col("n")).cast("int"))
    rows = docs.join(takes.select("__id", "__source", "__apart", "__size", (F.col("epochs") + again).cast("int").alias("__whole"), F.when(~F.col("some"), F.col("part")).otherwise(F.lit(0)).alias("__part"), "some"), of_row)
    parts = F.concat(F.expr("array_repeat(__size, __whole)"), F.when(F.col("__part") > 0, F.array("__part")).otherwise(F.array().cast("array<bigint>")))
    out = rows.withColumn("__words", F.explode(parts)).select(*docs.columns, "__words", "__size")
    if most_rows > 1 and takes.where("some").limit(1).count():  # at most one group a source
        cuts = takes.where("some").select("__id", "__source", "__apart", "__size", F.inline(F.array(F.struct(F.col("whole").alias("__rows"), F.col("__size").alias("__words")), F.struct((F.col("part") > 0).cast("long").alias("__rows"), F.col("part").alias("__words")))))
        one = docs.join(takes.where("some").select("__id", "__source", "__apart"), of_row).dropDuplicates(["__id", "__source", "__apart"])
        more = one.withColumnsRenamed({"__id": "__i", "__source": "__s", "__apart": "__a"}).join(cuts, F.col("__i").eqNullSafe(F.col("__id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__a") == F.col("__apart")))
        out = out.unionByName(_repeated(more, "__rows", most_rows > rows_a_range).select(*docs.columns, "__words", "__size"))
    text = F.when(F.col("__words") == F.col("__size"), F.col(text_col)).otherwise(F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int")), " "))
    out = out.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

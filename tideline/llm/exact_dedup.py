"""Exact duplicates by deterministic block naming. DataFrame functions only.

Texts are cut into blocks of a fixed size. The distinct blocks are sorted and numbered, so
that a block's number stands for its whole content. Adjacent pairs of numbers are then named
in the same way, level by level, until each text has one number: two texts have the same
(level, number) exactly when they are equal, because every name stands for one content.

* Block contents are shuffled once, after equal blocks of a task are merged. Everything later
  moves integers: positions and names.
* Blocks are looked up by a 64-bit bucket. The distinct contents of each bucket are counted
  over the whole input; where a bucket holds several, its blocks are told apart by content
  (their rank in it). A hash alone never decides.
* Joins are between written tables, so adaptive execution may split a name that a third of all
  rows share. Groups are counted before they are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table
from tideline.llm.rows import keep_rows
from tideline.session import materialise

BLOCK_CHARS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Bucket = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    norm = normalised(named(text_col).cast("string"))
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        named(id_col).alias("id"),
        F.sha2(norm, 256).alias("sha"),
        F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(cut).alias("blocks"),
    )


def _occurrences(rows: DataFrame, bucket: Bucket) -> DataFrame:
    """One row per block of each text; what belongs to the text stands on its first block."""
    apart = rows.select("row", "id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks"))
    first = F.col("pos") == 0
    return apart.select(
        "row",
        F.col("pos").cast("long").alias("pos"),
        F.col("n").cast("long").alias("n"),
        F.when(first, F.col("id")).alias("id"),
        F.when(first, F.col("sha")).alias("sha"),
        bucket(F.col("col")).alias("h"),
        F.col("col").alias("block"),
    )


def _number(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort distinct keys and number them; written, so that the numbers stay."""
    ordered = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id()))


def name_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket: Bucket = F.xxhash64,
) -> DataFrame:
    """One row per document: ``row`` (its number in this call), ``id``, ``sha`` (of the
    normalised text), ``level`` and ``name``; (level, name) is the identity of its text.

    ``docs`` should be a stored table or otherwise give the same rows each time it is read.
    """
    rows = _rows(docs, id_col, text_col, block_chars)
    contents = materialise(
        rows.select(F.explode("blocks").alias("block"))
        .select(bucket(F.col("block")).alias("h"), "block")
        .distinct()
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("contents"))
    )
    shared = contents.filter("contents > 1").select("h")
    found = _occurrences(rows, bucket)
    if shared.isEmpty():
        occurrences = materialise(found.drop("block").withColumn("rank", F.lit(0)))
        ranks = contents.select("h", F.lit(0).alias("rank"))
    else:  # several contents in one bucket: their order in it tells them apart
        inside = materialise(
            found.join(shared, "h", "left_semi")
            .select("h", "block")
            .distinct()
            .withColumn("rank", F.row_number().over(W.partitionBy("h").orderBy("block")) - 1)
        )
        occurrences = materialise(
            found.join(inside, ["h", "block"], "left")
            .drop("block")
            .withColumn("rank", F.coalesce("rank", F.lit(0)))
        )
        alone = contents.filter("contents = 1").select("h", F.lit(0).alias("rank"))
        ranks = alone.unionByName(inside.select("h", "rank"))
    names = _number(ranks, ["h", "rank"], "name")
    current = materialise(
        occurrences.select("row", "pos", "n", "h", "rank")
        .join(names, ["h", "rank"])
        .select("row", "pos", "n", "name")
    )

    longest = occurrences.agg(F.max("n")).first()[0] or 0
    level, done = 0, []
    while longest > 0:
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        longest = 0 if longest == 1 else (longest + 1) // 2
        if not longest:
            break
        even = F.col("pos") % 2 == 0
        pairs = materialise(
            current.filter("n > 1")
            .groupBy("row", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.shiftright(F.col("n") + 1, 1)).alias("n"),
                F.max(F.when(even, F.col("name"))).alias("l"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"),
            )
        )
        names = _number(pairs.select("l", "r").distinct(), ["l", "r"], "name")
        current = materialise(pairs.join(names, ["l", "r"]).select("row", "pos", "n", "name"))
        level += 1

    about = occurrences.filter("pos = 0").select("row", "id", "sha")
    if not done:
        return about.select("*", F.lit(0).alias("level"), F.lit(0).cast("long").alias("name"))
    return about.join(reduce(DataFrame.unionByName, done), "row")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    bucket: Bucket = F.xxhash64,
) -> DataFrame:
    """Groups of equal texts and the row of each group that stays, the one of the largest id.

    One row per input row: ``id``, ``keep_id``, ``group_size``, ``kept``, ``sha``. Null text is
    the empty text. Null ids rank lowest; of rows with the same id and the same text one stays.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    rows = materialise(name_texts(docs, id_col, text_col, block_chars, bucket))
    groups = materialise(
        rows.groupBy("level", "name").agg(
            F.max(F.struct("id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")
        )
    )
    return rows.join(groups, ["level", "name"]).select(
        "id",
        F.col("last.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"),
        "sha",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    rows = exact_groups(docs, id_col, text_col).withColumnRenamed("sha", "mark")
    return keep_rows(docs, id_col, F.sha2(normalised(named(text_col).cast("string")), 256), rows)


ORACLE = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


@query("op5_exact_dedup", ORACLE)
def op5_exact_dedup(spark, sf_dir):
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )

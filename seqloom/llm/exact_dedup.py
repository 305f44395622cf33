"""Exact dedup by a tree merge of sorted digest runs.

Every row gets a tag that fixes its lane; a digest's first bytes fix its range. For each lane and range a run is one
entry per digest, sorted, with the row that stays and the number of rows. In each round FAN_IN neighbouring lanes hand
their runs to one lane: a partition has the runs of one range that go to a lane, the sort merges them, and one pass
over the merged order makes each digest's entries one. After the last round one lane holds one entry per distinct text,
range by range. The survivors of groups of two or more then walk the same tree downwards, lane by lane, to the rows. An
entry meets at most FAN_IN others of its digest in any round and a leaf only the rows of its lane, so a text that a
third of all rows share is spread over all lanes, both ways.

Entries merge only if SHA-256, the length in bytes and an independent 64-bit hash agree; that is the verification of the
retained identifier at each level. Texts themselves are read once and never shuffled. Each level is written, so a lost
executor costs no more than its part of one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import bounded, materialise, partitions, whole_text

FAN_IN = 16
RANGES = 4  # of a lane for each partition, by a digest's first two bytes
KEY = ["digest", "n_bytes", "check"]


def rounds_for(lanes: int, fan_in: int = FAN_IN) -> int:
    """The rounds of merging that reach at least this many lanes."""
    rounds = 1
    while fan_in**rounds < lanes:
        rounds += 1
    return rounds


def merged_runs(entries: DataFrame) -> DataFrame:
    """The entries (lane, range, KEY, best, n) of each lane and range merged: sorted, and one for each digest.

    The greatest struct has no buffer in place, so Spark aggregates over the sorted order and doesn't hash.
    """
    own = ["range", "lane", *KEY]
    runs = entries.repartition("range", "lane").sortWithinPartitions(*own)
    return runs.groupBy(*own).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty, and empty texts are copies of each other. Of equal
    texts the row with the largest (keep="max") or smallest ("min") doc_id stays; a null doc_id ranks last. Rows
    repeated with one doc_id and text are copies too: exactly one of them has kept = true. An empty table gives no
    rows. Other columns of docs are not read.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    spark = docs.sparkSession
    rounds, ranges = rounds_for(partitions(spark), fan_in), min(1 << 16, RANGES * partitions(spark))
    body = whole_text(text)
    rows = materialise(
        docs.select(
            F.col(doc_id).cast("long").alias("id"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
            F.octet_length(body).alias("n_bytes"),
            F.xxhash64(body).alias("check"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "digests",
    ).withColumns({"lane": F.pmod(F.xxhash64("tag"), F.lit(fan_in**rounds)), "range": F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("long") * ranges, 16)})

    rank = F.col("id") if keep == "max" else F.bitwise_not("id")  # reverses the order without an overflow
    best = F.struct(F.col("id").isNotNull().alias("named"), rank.alias("rank"), F.col("tag").alias("tag"), F.col("id").alias("id"))
    levels = [materialise(merged_runs(rows.select("range", "lane", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))), "runs")]
    for _ in range(rounds):
        levels.append(materialise(merged_runs(levels[-1].withColumn("lane", F.floor(F.col("lane") / fan_in))), "runs"))
    verdict = levels[-1].filter("n > 1").select("lane", *KEY, "best", "n")
    for level in levels[-2::-1]:
        verdict = (
            level.select("lane", *KEY, F.floor(F.col("lane") / fan_in).alias("above"))
            .join(verdict.withColumnRenamed("lane", "above"), ["above", *KEY])
            .drop("above")
        )
    return (
        rows.join(verdict, ["lane", *KEY], "left")
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("tag") == F.col("best.tag"), F.lit(True)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay under exact_dedup(), all columns as they are.

    A row goes by its doc_id and text together, so an id that stands for several texts keeps those that stay. Of rows
    repeated with one doc_id and text (a null doc_id too) one stays, any of them if other columns differ.
    """
    verdict = exact_dedup(docs, text, doc_id).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    said = materialise(verdict.filter("NOT kept OR rows > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text"), "kept"), "copies")

    def rows_of(df: DataFrame, own: DataFrame, how: str) -> DataFrame:
        own = bounded(own.select("gone_id", "gone_text"))
        return df.join(own, df[doc_id].cast("long").eqNullSafe(own["gone_id"]) & (F.sha2(F.coalesce(df[text].cast("string"), F.lit("")), 256) == own["gone_text"]), how)

    left, repeated = rows_of(docs, said.filter("NOT kept"), "left_anti"), said.filter("kept")
    if not repeated.limit(1).count():
        return left
    name = next(n for i in range(len(docs.columns) + 1) if (n := f"body{i}") not in docs.columns)
    once = rows_of(left, repeated, "left_semi").withColumn(name, whole_text(text)).dropDuplicates([doc_id, name]).drop(name)
    return rows_of(left, repeated, "left_anti").unionByName(once)

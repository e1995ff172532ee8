"""Sources and sinks: unquoted TSV, parquet, matching lists."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns=None, overrides: dict[str, str] | None = None) -> DataFrame:
    """The columns named (all by default) as strings, or of the types in `overrides`; quotes are ordinary characters.

    The header decides where a column stands; Spark's reader parses the columns that are asked for only.
    """
    whole = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    kinds = overrides or {}
    return whole.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in columns or whole.columns))


def write_tsv(df: DataFrame, path: str) -> None:
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.csv(path, sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    t = read_tsv(spark, path, ("source1_entity_id", "matched_entity_ids"))
    return explode_ids(t, "source1_entity_id", "matched_entity_ids").select(F.col("source1_entity_id").alias("s1_id"), F.col("id").alias("q_id"))


def explode_ids(df: DataFrame, key: str, ids: str) -> DataFrame:
    return df.select(key, F.explode(F.split(F.coalesce(ids, F.lit("")), ",")).alias("id")).where("id <> ''")


def matching_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each s: its sorted records as a comma list, empty where there are none."""
    lists = pairs.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_set("q")), lambda x: x.cast("string")), ",").alias("matched"))
    return entities.select("s").join(lists, "s", "left").withColumn("matched", F.coalesce("matched", F.lit("")))


def splice(base: DataFrame, donor: DataFrame, column: str, values: list) -> DataFrame:
    """base with the rows of some values replaced by the donor's."""
    return base.where(~F.col(column).isin(values)).unionByName(donor.where(F.col(column).isin(values)))


def write_missing(df: DataFrame, path: str, column: str, values: list) -> list:
    """Writes the partitions that are not there yet and returns their values; one that failed half-way has no mark and is redone.

    A partition counts as done once Spark's committer has left its _SUCCESS mark in it.
    """
    done = [v for v in values if exists(df.sparkSession, f"{path}/{column}={v}/_SUCCESS")]
    todo = [v for v in values if v not in done]
    for v in todo:
        df.where(F.col(column) == v).drop(column).write.mode("overwrite").parquet(f"{path}/{column}={v}")
    return todo


def read_chunks(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All chunk folders under path that fit the pattern; partition columns stay columns."""
    return spark.read.option("basePath", path).parquet(f"{path}/{pattern}")


def reuse(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """A build in which the new build's values of `column` replace the old ones and all others are read where they are."""
    return old.join(F.broadcast(new.select(column).distinct()), column, "left_anti").unionByName(new)


def checksum(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Rows and an order-free sum of md5 digits for each value of `by`: equal tables have equal sums, whatever their files."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 7), 16, 10).cast("long")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.sum(digits).alias("digest"))


def bundle(tables: dict[str, tuple[DataFrame, str]], used: DataFrame) -> DataFrame:
    """Of each table (rows, id column) the ids that `used` (column id) names, with the table's name."""
    parts = [t.select(F.lit(n).alias("tbl"), F.col(c).cast("long").alias("id")).join(used, "id", "left_semi") for n, (t, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def write_rules(path: str, rules: dict) -> None:
    """A rule file: {'decision': {country or 'default': {type, t or floor, alpha}}, 'x': [...], 'y': [...]}."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rules, f, sort_keys=True)


def read_rules(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def rule_table(spark: SparkSession, rules: dict) -> DataFrame:
    """country, type, t, floor, alpha: one row for each rule, as few as there are countries."""
    rows = [(c, r["type"], float(r.get("t", 0)), float(r.get("floor", 0)), float(r.get("alpha", 1))) for c, r in sorted(rules["decision"].items())]
    return spark.createDataFrame(rows, "country string, type string, t double, floor double, alpha double")


def read_npy(spark: SparkSession, path: str, name: str = "v") -> DataFrame:
    """row, vector of a two-dimensional .npy file, mapped and not loaded; every task reads its own stretch of rows.

    The file must lie in a folder that all executors see.
    """
    n = np.load(path, mmap_mode="r").shape[0]

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            x = np.load(path, mmap_mode="r")[at].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["row", name])

    return spark.range(n).withColumnRenamed("id", "row").mapInArrow(run, f"row long, {name} array<float>")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the session; only a session in one process may do without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def drop(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)

"""Reading posts, gold sets and corpora, and writing results. The readers take any path that Spark reads."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..labels import LABELS
from ..operators.sampling import numbered


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV by header, or JSON: an array, lines, or an object with a `data` array."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = spark.read.option("multiLine", True).json(path)
    if raw.columns == ["data"]:
        return raw.select(F.explode("data").alias("x")).select("x.*")
    return raw


KNOWN = ("id", "post_id", "text", "label", "gold", "subtype", "slice_type", "ambiguous_stance", "platform")
CORRUPT = "_corrupt"


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine) of a CSV file with header, JSON lines or a JSON array, read by a schema of strings and never inferred.

    rows: the known columns that the file has (CSV) or all of them (JSON). quarantine: record, reason; `malformed` is a record that does not parse
    or, in CSV, has more or fewer fields than the header, as it stands; `no text` is one without text, as JSON."""
    first = next((r["value"].strip() for r in spark.read.text(path).limit(20).collect() if r["value"].strip()), "")
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if path.lower().rstrip("/").endswith(".csv"):
        names = [c.strip() for c in next(csv.reader([first]), [])]
        form = ", ".join(f"`{c}` string" for c in names) + f", {CORRUPT} string"
        raw = reader.schema(form).option("header", True).option("multiLine", True).option("escape", '"').option("columnPruning", False).csv(path)
    else:
        names = list(KNOWN)
        raw = reader.schema(", ".join(f"{c} string" for c in names) + f", {CORRUPT} string").option("multiLine", first.startswith("[")).json(path)
    used = [c for c in KNOWN if c in names]
    rows = raw.withColumn("_all", F.to_json(F.struct(*[F.col(f"`{c}`") for c in used])) if used else F.lit("{}"))
    blank = F.coalesce(F.trim("text"), F.lit("")) == "" if "text" in used else F.lit(True)
    broken = F.col(CORRUPT).isNotNull()
    bad = rows.where(broken | blank).select(F.when(broken, F.col(CORRUPT)).otherwise(F.col("_all")).alias("record"), F.when(broken, "malformed").otherwise("no text").alias("reason"))
    return rows.where(~broken & ~blank).select(*used), bad


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where the files they come from are too few for that; for narrow rows that much work per row follows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _renamed(raw: DataFrame) -> DataFrame:
    df = raw.toDF(*[c.strip() for c in raw.columns])
    if "post_id" not in df.columns and "id" in df.columns:
        df = df.withColumnRenamed("id", "post_id")
    if "text" not in df.columns:
        raise ValueError(f"need a column `text`, got {df.columns}")
    return df if "post_id" in df.columns else numbered(df, "post_id")


def standard_posts(raw: DataFrame) -> DataFrame:
    """(post_id, text): trimmed; null and blank texts go, after rows without ids were numbered."""
    df = _renamed(raw)
    return df.select(F.col("post_id").cast("string").alias("post_id"), F.trim("text").alias("text")).where("text <> ''")


def standard_gold(raw: DataFrame) -> DataFrame:
    """Posts with label (or gold), and subtype, slice_type and ambiguous_stance where given."""
    df = _renamed(raw)
    if "label" not in df.columns and "gold" in df.columns:
        df = df.withColumnRenamed("gold", "label")
    extra = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("subtype", "slice_type", "ambiguous_stance")]
    return df.select(F.col("post_id").cast("string").alias("post_id"), F.trim("text").alias("text"), F.trim(F.col("label")).alias("label"), *extra).where("text <> ''")


def load_posts(spark: SparkSession, path: str) -> DataFrame:
    return standard_posts(read_table(spark, path))


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return standard_gold(read_table(spark, path))


def binary_corpus(raw: DataFrame) -> DataFrame:
    """(text, binary_label) from columns content or text, and label, whatever their case; labels other than 0 and 1 go."""
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    text = "content" if "content" in df.columns else "text"
    number = F.col("label").cast("string").try_cast("double")
    return df.select(F.col(text).cast("string").alias("text"), number.alias("n")).where(F.col("text").isNotNull() & F.col("n").isNotNull()).select("text", F.col("n").cast("int").alias("binary_label")).where(F.col("binary_label").isin(0, 1))


def four_way_corpus(raw: DataFrame) -> DataFrame:
    df = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return df.select(F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label")).where(F.col("label").isin(*LABELS))


def save(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Results as parquet, JSON lines (nulls kept) or CSV with header and doubled quotes (arrays and structs as JSON)."""
    if form == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
        df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})
    df.write.mode("overwrite").format(form).options(**({"header": True, "escape": '"'} if form == "csv" else {"ignoreNullFields": False} if form == "json" else {})).save(path)


def thresholds_table(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, label, threshold, margin) from a nested or flat object; unknown classes are ignored. raw: one JSON text per row in `value`."""
    get = lambda p: F.get_json_object("value", p).cast("double")
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(get(f"$.thresholds.{k}"), get(f"$.{k}")).alias("threshold")) for k in LABELS])
    margin = F.coalesce(get("$.ambiguity_margin"), get("$.meta.ambiguity_margin"))
    return raw.select(*keep, F.explode(rows).alias("x"), margin.alias("margin")).select(*keep, "x.label", "x.threshold", "margin").where(F.col("threshold").isNotNull())


def thresholds_json(thresholds: dict[str, Column], margin: Column) -> Column:
    return F.to_json(F.struct(F.struct(*[v.alias(k) for k, v in thresholds.items()]).alias("thresholds"), margin.alias("ambiguity_margin")))

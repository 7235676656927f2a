"""The incident file, the stored raw table and the layered views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from blotter import schema
from blotter.operators import clean as cleaning

YEAR = "incident_year"
FILE_ROWS = 10_000_000


def scan_csv(spark: SparkSession, path: str, row_schema=schema.RAW) -> DataFrame:
    """Header CSV with a declared schema; malformed lines are skipped.

    The schema is declared rather than inferred: inference would read the
    whole data set once more. A line is malformed when it has too many fields
    or a typed field does not parse. Fields are read as text and the types are
    checked by a filter, so the kept rows do not depend on the columns a query
    uses; column pruning inside the parser is off for the same reason. Queries
    should read the stored raw table, which does prune.
    """
    text = StructType([StructField(f.name, StringType()) for f in row_schema.fields])
    lines = (
        spark.read.schema(text)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .option("columnPruning", False)
        .option("escape", '"')
        .csv(path)
    )
    cells = []
    for field in row_schema.fields:
        kind = field.dataType.simpleString()
        if kind != "string":
            parsed = F.trim(field.name).try_cast(kind)
            lines = lines.filter(F.col(field.name).isNull() | parsed.isNotNull())
            cells.append(parsed.alias(field.name))
        else:
            cells.append(F.col(field.name))
    return lines.select(*cells)


def store_raw(raw: DataFrame, path: str, year_column: str = YEAR, row_id: str = schema.ROW_KEYS[0], file_rows: int = FILE_ROWS) -> None:
    """Replace the stored raw table, partitioned by the year of ``Dates``.

    Rows without an identifier get one from their place in the scanned files, so
    stored rows can be split, sampled and joined by key. Adaptive execution deals
    the years out in tasks of its advisory size, so a year that holds most of the
    data is written by many tasks; ``file_rows`` bounds a file.
    """
    year = F.year(F.col("Dates").try_cast("timestamp_ntz"))
    if row_id not in raw.columns:
        raw = raw.withColumn(row_id, F.monotonically_increasing_id())
    (
        raw.withColumn(year_column, year)
        .hint("rebalance", year_column)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy(year_column)
        .parquet(path)
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register_views(raw: DataFrame, prefix: str = "incident", mode: str = "intended") -> dict[str, str]:
    """Replace the raw, clean, feature and modeling views; returns their names."""
    clean = cleaning.clean(raw, mode=mode)
    features = cleaning.with_features(clean, mode=mode)
    layers = {
        "raw": raw,
        "clean": clean,
        "features": features,
        "modeling": cleaning.modeling(features),
    }
    names = {}
    for layer, frame in layers.items():
        names[layer] = f"{prefix}_{layer}"
        frame.createOrReplaceTempView(names[layer])
    return names


def modeling_frame(raw: DataFrame, mode: str = "intended", keep=schema.ROW_KEYS) -> DataFrame:
    """Raw rows to modeling rows in one lazy plan."""
    clean = cleaning.clean(raw, mode=mode, keep=keep)
    return cleaning.modeling(cleaning.with_features(clean, mode=mode), keep=keep)


def load_modeling(spark: SparkSession, view: str = "incident_modeling", ordered: bool = False) -> DataFrame:
    """The modeling view; a global order is only made when asked for."""
    frame = spark.table(view)
    return frame.orderBy("incident_timestamp") if ordered else frame


def split_target(df: DataFrame, target: str = "target") -> tuple[DataFrame, DataFrame]:
    """Predictors and target of the same rows."""
    schema.require_columns(df, [target])
    return df.drop(target), df.select(target)

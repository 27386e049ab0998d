"""Text sources: header CSVs, region tables, lookups, listings and volume inventories."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.constants import (
    COMPARTMENTS,
    LISTING_ID_PATTERN,
    METADATA_COLUMNS,
    RATING_TITLES,
    REGION_TABLE_COLUMNS,
)

REGION_TABLE_TYPES = {
    "label": "int",
    "name": "string",
    "compartment": "string",
    "parcel_voxels": "bigint",
    "compartment_voxels": "bigint",
    "overlap_voxels": "bigint",
    "overlap_volume_mm3": "double",
    "pct_of_parcel": "double",
    "pct_of_compartment": "double",
}


def _text_schema(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` STRING" for c in columns)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A header CSV with every column as text; the header must match."""
    return spark.read.schema(_text_schema(columns)).csv(path, header=True, enforceSchema=False)


def pick_columns(df: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """The columns whose titles fit, under short names.

    ``patterns`` maps a name to a regular expression for the start of a title, whatever its
    case. Patterns are tried in order and a title goes to the first that fits; of several
    titles for one name the last counts. A name without a title is a NULL column.
    """
    found: dict[str, str] = {}
    for title in df.columns:
        for name, pattern in patterns.items():
            if re.match(pattern, title.strip(), re.IGNORECASE):
                found[name] = title
                break
    return df.select(*[
        F.col(f"`{found[name]}`").alias(name) if name in found else F.lit(None).cast("string").alias(name)
        for name in patterns])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Expert ratings (patient_id, timepoint, rano, rano_rationale, line) from a CSV whose long
    titles carry commas and explanations; only their beginnings are relied upon."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return pick_columns(rows, RATING_TITLES)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_text(spark, path, METADATA_COLUMNS)


def rows_of_patient(rows: DataFrame, patient: str) -> DataFrame:
    """Rows of one patient, compared without case and surrounding blanks."""
    return rows.where(F.lower(F.trim("Patient")) == patient.strip().lower())


def listing_ids(lines: DataFrame, pattern: str = LISTING_ID_PATTERN) -> DataFrame:
    """Every subject id that a directory listing mentions."""
    return lines.select(
        F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("subject_id")
    ).distinct()


def read_region_tables(spark: SparkSession, path: str) -> DataFrame:
    """Region tables as text until they are checked; ``subject_id`` is the last column, or the
    folder ``subject_id=.../`` a table lies in. Folders of buckets may lie between."""
    columns = [*REGION_TABLE_TYPES]
    return spark.read.schema(_text_schema([*columns, "subject_id"])).csv(path, header=True)


def check_region_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed rows of good subjects, problems). One bad row rejects its whole subject."""
    missing = [c for c in REGION_TABLE_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    known = F.coalesce(F.col("compartment").isin(*COMPARTMENTS), F.lit(False))
    numeric = [c for c in REGION_TABLE_COLUMNS if REGION_TABLE_TYPES[c] != "string"]
    malformed = F.lit(False)
    for c in numeric:
        malformed = malformed | F.col(c).try_cast(REGION_TABLE_TYPES[c]).isNull()
    verdict = rows.groupBy("subject_id").agg(
        F.min(F.when(~known, F.coalesce("compartment", F.lit("")))).alias("odd"),
        F.count_if(malformed).alias("n_malformed"),
    )
    reason = F.when(
        F.col("odd").isNotNull(), F.concat(F.lit("unexpected compartment: "), F.col("odd"))
    ).when(F.col("n_malformed") > 0, F.lit("malformed row"))
    problems = verdict.select("subject_id", reason.alias("reason")).where(
        F.col("reason").isNotNull())
    good = rows.join(problems, "subject_id", "left_anti").select("subject_id", *[
        F.col(c).try_cast(t).alias(c) for c, t in REGION_TABLE_TYPES.items() if c in rows.columns])
    return good, problems


def parse_lut_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lookups (subject_id, value) to rows (subject_id, label, name), and problems."""
    parsed = documents.withColumn("lut", F.from_json("value", "map<string,string>"))
    is_int = lambda k: k.try_cast("int").isNotNull()
    bad_key = F.array_min(F.filter(F.map_keys("lut"), lambda k: ~is_int(k)))
    root = F.schema_of_variant(F.try_parse_json("value"))
    judged = parsed.withColumn("reason", (
        F.when(F.try_parse_json("value").isNull(), F.lit("invalid JSON"))
        .when(~root.startswith("OBJECT"), F.lit("root is not an object"))
        .when(F.size("lut") == 0, F.lit("empty lookup"))
        .when(bad_key.isNotNull(), F.concat(F.lit("bad label key: "), bad_key))
    ))
    rows = judged.where(F.col("reason").isNull()).select(
        "subject_id", F.explode("lut").alias("key", "name")
    ).select("subject_id", F.col("key").cast("int").alias("label"), "name")
    problems = judged.where(F.col("reason").isNotNull()).select("subject_id", "reason")
    return rows, problems


def parse_color_table(lines: DataFrame) -> DataFrame:
    """Whitespace table ``label name r g b``; blank, comment, short and non-integer lines skip."""
    line = F.trim(F.col("value"))
    parts = F.split(line, r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return (
        lines.where((line != "") & ~line.startswith("#") & (F.size(parts) >= 5))
        .select(
            number(0).alias("label"), F.get(parts, F.lit(1)).alias("name"),
            number(2).alias("r"), number(3).alias("g"), number(4).alias("b"),
        )
        .where(
            F.col("label").isNotNull() & F.col("r").isNotNull() & F.col("g").isNotNull()
            & F.col("b").isNotNull()
        )
    )


def read_voxels(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Voxel table partitioned by ``source``; a named source reads only its own files."""
    voxels = spark.read.parquet(path)
    return voxels if source is None else voxels.where(F.col("source") == source)


def read_file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` relative to the root, ``size_bytes`` and time of every file below a root.

    The listing comes from the file source's own columns; no content is read. Names that a
    writer escaped (``%20``) are given back plain. Spark lists no file of zero bytes.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(path)
    )
    below = F.regexp_extract(F.url_decode("path"), f"/{path.rstrip('/').rsplit('/', 1)[-1]}/(.*)$", 1)
    return files.select(
        below.alias("path"), F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"))


def read_packed_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``read_file_inventory`` for files that ``sinks.pack_files`` keeps; no
    content is read, and files of zero bytes are listed."""
    return spark.read.schema("path STRING, modificationTime TIMESTAMP, length BIGINT").parquet(path).select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def volume_inventory(files: DataFrame, headers: DataFrame) -> DataFrame:
    """Per file: path, size_bytes, shape, voxel_size_mm, orientation, dtype.

    ``headers`` has those header fields by path. Orientation is ``?`` where a header does not
    tell it; a file without a header keeps its row, with the other fields missing.
    """
    fields = ["shape", "voxel_size_mm", "orientation", "dtype"]
    joined = files.join(headers.select("path", *fields, F.lit(True).alias("_read")), "path", "left")
    known = F.when(F.col("_read"), F.coalesce("orientation", F.lit("?")))
    return joined.withColumn("orientation", known).select("path", "size_bytes", *fields)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same rows; an empty source is an error. Looks for one row, no more."""
    if df.isEmpty():
        raise ValueError(f"{what} has no usable row")
    return df

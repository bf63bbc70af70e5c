"""Dirty CSV sources and clean CSV sinks (operators A1-A5).

Spark's CSV reader does the quoting (fields spanning lines, quotes, blank lines);
a schema as wide as the widest record catches ragged rows, which are then padded or
merged into the last column; the field rules are column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_field(c) -> F.Column:
    """A3: trimmed; one pair of outer quotes dropped; ``""`` -> ``"``; a JSON list
    re-serialised as ``["a", "b"]``; CR/LF -> blank."""
    v = _strip(F.col(c) if isinstance(c, str) else c)
    v = F.when(v.startswith('"') & v.endswith('"') & (F.length(v) >= 2),
               F.substring(v, 2, F.greatest(F.length(v) - 2, F.lit(0)))).otherwise(v)
    v = F.replace(v, F.lit('""'), F.lit('"'))
    js = F.from_json(v, "array<string>")
    items = F.transform(js, lambda x: F.regexp_replace(F.regexp_replace(F.to_json(F.array(x)), r"^\[", ""), r"\]$", ""))
    relist = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    v = F.when(v.startswith("[") & v.endswith("]") & js.isNotNull(), relist).otherwise(v)
    return F.regexp_replace(v, r"[\r\n]", " ")


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Header names: the first line split on ``,`` and stripped (one small read)."""
    first = spark.read.text(path).limit(1).first()
    return [h.strip() for h in first[0].split(",")] if first else []


def _reader(spark: SparkSession, names: list[str]):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
            .option("mode", "PERMISSIVE").option("enforceSchema", True).option("maxColumns", 1_000_000))


def extra_fields(spark: SparkSession, path: str, cols: list[str]) -> int:
    """Fields that some record may have beyond the header's: Spark hands back records that do not fit the
    header as raw text, and a record has at most one field more than it has commas."""
    raw = _reader(spark, [*cols, "_raw"]).option("columnNameOfCorruptRecord", "_raw").option("columnPruning", False).csv(path)
    commas = F.length("_raw") - F.length(F.replace(F.col("_raw"), F.lit(","), F.lit("")))
    most = raw.select(commas.alias("n"), *cols).agg(F.max("n"), *[F.count(F.col(c)) for c in cols]).first()[0]
    return max(0, (most or 0) + 1 - len(cols))


def read_dirty_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A1 + A2 + A3: every field a string; multi-line quoted fields joined with one
    blank; short rows padded with ""; extra fields joined to the last column with
    ", "; quote characters removed; fields cleaned."""
    cols = columns or read_header(spark, path)
    extra = [f"_x{i}" for i in range(extra_fields(spark, path, cols))]
    raw = _reader(spark, cols + extra).csv(path)
    joined = {c: F.regexp_replace(F.col(c), r"\s*[\r\n]+\s*", " ") for c in cols + extra}
    last = cols[-1]
    merged = F.concat_ws(", ", joined[last], *[joined[x] for x in extra])
    out = []
    for c in cols:
        v = merged if c == last else joined[c]
        out.append(clean_field(F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit(""))).alias(c))
    return raw.select(*out)


def write_clean_csv(df: DataFrame, path: str) -> None:
    """A4: minimal quoting, backslash escape, no quote doubling, with a header."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", "\\")
     .option("escapeQuotes", True).option("emptyValue", "").csv(path))


def clean_all(spark: SparkSession, manifest: dict[str, str], out_dir: str) -> DataFrame:
    """A5: clean every table of the manifest (type -> path) to ``clean_<type>``; a
    failing table does not stop the rest. -> file_type, path, out_path, rows, ok."""
    status = []
    for kind, path in manifest.items():  # a loop over a handful of file names, not over data
        out = f"{out_dir.rstrip('/')}/clean_{kind}"
        try:
            df = read_dirty_csv(spark, path)
            write_clean_csv(df, out)
            status.append((kind, path, out, spark.read.option("header", True).csv(out).count(), True))
        except Exception:  # noqa: BLE001 - the report records the failure
            status.append((kind, path, None, 0, False))
    return spark.createDataFrame(status, "file_type string, path string, out_path string, rows long, ok boolean")

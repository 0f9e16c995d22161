"""File sources and sinks: Parquet, and CSV with a fallback for the text encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.kinds import NESTED, TEXT, col, kind_of, normalise_nulls
from tabkit.sources import quoted

# Order in which encodings are tried. Fixed values.
ENCODINGS = ("utf-8", "latin1", "iso-8859-1", "cp1252")

_JAVA_NAMES = {"utf-8": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}

# Fields that pandas reads as missing. Fixed values.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii]nf|[Ii]nfinity)\s*$"
_DAY = r"\d{4}-\d{2}-\d{2}"

#: Types from narrow to wide, each with its test of a text.
_TYPE_TESTS = [
    ("int", lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("int").isNotNull()),
    ("bigint", lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & c.try_cast("bigint").isNotNull()),
    ("double", lambda c: c.rlike(_NUMBER)),
    ("date", lambda c: c.rlike(f"^{_DAY}$") & c.try_cast("date").isNotNull()),
    ("timestamp", lambda c: c.rlike(rf"^{_DAY}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})?)?$") & c.try_cast("timestamp").isNotNull()),
    ("boolean", lambda c: F.lower(c).isin("true", "false")),
]


def read_parquet(spark: SparkSession, path: str | Sequence[str], nan_as_null: bool = True) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return normalise_nulls(df) if nan_as_null else df


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    """The first encoding that decodes every byte.

    The CSV reader replaces undecodable bytes instead of failing, so UTF-8 is checked on the raw lines, as a
    scan that ends at the first broken one. Every byte string is valid Latin-1: later entries are not reached.
    """
    for encoding in encodings:
        if _JAVA_NAMES.get(encoding.lower()) != "UTF-8":
            return encoding
        broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
        if broken.isEmpty():
            return encoding
    raise ValueError("could not read the file with any supported encoding")


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some line may end inside quotes: such a line has an odd number of them."""
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))), F.lit(2)) == 1
    return not spark.read.text(path).where(odd).limit(1).isEmpty()


def _inferred(texts: DataFrame) -> T.StructType:
    """The narrowest type that holds every value of each text column, found in one aggregate."""
    tests = [(c, name, t) for c in texts.columns for name, t in _TYPE_TESTS]
    failures = [F.max(F.when(col(c).isNotNull(), ~test(col(c)))).alias(f"f{i}") for i, (c, _, test) in enumerate(tests)]
    seen = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(texts.columns)]
    row = texts.agg(*failures, *seen).first()
    fields = []
    for i, c in enumerate(texts.columns):
        own = [name for j, (of, name, _) in enumerate(tests) if of == c and row[f"f{j}"] is False]
        fields.append(T.StructField(c, T.StructType.fromDDL(f"x {own[0]}")[0].dataType if own and row[f"n{i}"] else T.StringType()))
    return T.StructType(fields)


def read_csv(
    spark: SparkSession,
    path: str,
    encodings: Sequence[str] = ENCODINGS,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    missing: Sequence[str] = MISSING_MARKERS,
    mode: str = "FAILFAST",
) -> DataFrame:
    """CSV with a header row and inferred types, unless a schema is given (one pass less).

    Fields that equal one of ``missing`` are null before types are judged, so a numeric column with ``NA`` stays
    numeric. Under a given schema, a field that is not of its column's type is null. A row with a wrong number of
    fields is an error; ``mode="PERMISSIVE"`` fills short rows with nulls and cuts long ones. Unless
    ``multi_line`` is given, the lines are searched for quoted line breaks; files with some are split like others, after
    a pass that finds where records start (``tabkit.sources.quoted``).
    """
    encoding = detect_encoding(spark, path, encodings)
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    reader = (
        spark.read.option("header", True)
        .option("encoding", _JAVA_NAMES.get(encoding.lower(), encoding))
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", mode)
    )
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line:
        names = reader.csv(path).columns if schema is None else [f.name for f in schema.fields]
        raw = quoted.read(spark, path, names, _JAVA_NAMES.get(encoding.lower(), encoding), mode)
    else:
        if schema is not None:
            reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]))
        raw = reader.csv(path)
    texts = raw.select(*[F.when(~col(c).isin(list(missing)), col(c)).alias(c) for c in raw.columns]) if missing else raw
    schema = _inferred(texts) if schema is None else schema
    return normalise_nulls(texts.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]))


def read_scoring_csv(
    spark: SparkSession,
    path: str,
    features: T.StructType,
    multi_line: bool | None = None,
    missing: Sequence[str] = MISSING_MARKERS,
    mode: str = "FAILFAST",
) -> DataFrame:
    """A CSV to be scored: columns the model knows get their training type, extra columns stay text."""
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path)
    header = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path).columns
    known = {f.name: f.dataType for f in features.fields}
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    return read_csv(spark, path, schema=schema, multi_line=multi_line, missing=missing, mode=mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of CSV parts with a header; nested columns are written as JSON text."""
    flat = [
        (F.to_json(col(f.name)) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, key: str | Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in the order of ``key``; a table has no order of its own."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def stringify(df: DataFrame) -> DataFrame:
    """Text for display: text stays, nested values become JSON, other types are unchanged. Null becomes 'nan'."""

    def shown(f: T.StructField) -> Column:
        c = col(f.name)
        if kind_of(f.dataType) == TEXT:
            return F.coalesce(c.cast("string"), F.lit("nan")).alias(f.name)
        if kind_of(f.dataType) == NESTED:
            text = (
                F.to_json(c)
                if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
                else c.cast("string")
            )
            return F.coalesce(text, F.lit("nan")).alias(f.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])

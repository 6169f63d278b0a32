"""Texts and tables in, tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.preprocess import preprocess
from ..functions.text import raw_words, split_documents, trim
from ..operators.matching import ValidationError
from .csv_table import csv_table, split_rows

#: Most characters of one content, bytes of one uploaded file, rows of a pasted table, rows of a payload that is handed out.
MOST_CHARACTERS, MOST_BYTES, MOST_ROWS, MOST_PAYLOAD = 5_000_000, 10 * 1024 * 1024, 200_000, 50_000


def validate_content(content: str) -> str:
    """A content as it is stored: not blank, not binary, not too long, line ends as LF."""
    if not content.strip():
        raise ValidationError("the content is empty")
    if len(content) > MOST_CHARACTERS:
        raise ValidationError(f"the content has more than {MOST_CHARACTERS:,} characters")
    if "\0" in content:
        raise ValidationError("the content looks like binary data")
    return content.replace("\r\n", "\n").replace("\r", "\n")


def pasted(spark: SparkSession, content: str) -> DataFrame:
    """``doc_id, text``: the non-blank lines of a pasted content, in order."""
    frame = spark.createDataFrame([(validate_content(content),)], "content string")
    return frame.select(F.posexplode(split_documents(F.col("content"))).alias("doc_id", "text")).select(F.col("doc_id").cast("long"), "text")


def check_upload(spark: SparkSession, path: str) -> str:
    """The path of a single file that is small enough to be one content."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
    if size > MOST_BYTES:
        raise ValidationError(f"the file has {size:,} bytes; at most {MOST_BYTES:,} are taken")
    return path


def read_text(spark: SparkSession, path: str, upload: bool = False) -> DataFrame:
    """``file, line, text``: the non-blank lines of text files, trimmed; ``line`` counts from 0 among them.

    An ``upload`` is one file of at most MOST_BYTES; other paths may hold any number of any size.
    """
    if upload:
        check_upload(spark, path)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("t"))
    return whole.select("file", F.posexplode(split_documents(F.col("t"))).alias("line", "text"))


def parse_csv(content: str) -> list[list[str]]:
    """Rows of a pasted table: quotes open anywhere in a field, doubled ones stand for one; rows of blanks alone are left out."""
    rows = split_rows(content)
    if len(rows) > MOST_ROWS:
        raise ValidationError(f"the table has more than {MOST_ROWS:,} rows")
    return rows


def pasted_csv(spark: SparkSession, content: str, column: str | None = None) -> DataFrame:
    """``text``: one document per row of a pasted table, as :func:`read_csv` takes them from files."""
    rows = parse_csv(content)
    if len(rows) < 2:
        raise ValidationError("a header and one row are needed")
    width = len(rows[0])
    data = [tuple((r + [""] * width)[:width]) for r in rows[1:]]
    names = [c.strip() for c in rows[0]]
    # Positions as names, as header names may repeat.
    table = spark.createDataFrame(data, ", ".join(f"c{k} string" for k in range(width)))
    if column is not None and column not in names:
        raise ValidationError(f"no column {column!r}; there are {', '.join(names)}")
    return _documents(table, longest_column(table) if column is None else f"c{names.index(column)}")


def read_csv(spark: SparkSession, path: str, column: str | None = None, upload: bool = False) -> DataFrame:
    """``text``: one document per row, from the named column or the one with the longest values on average.

    Quoting is that of pasted tables; line breaks within fields become spaces; header
    names are trimmed; blank values are left out.  A large file is read by many tasks.
    """
    if upload:
        check_upload(spark, path)
    table = csv_table(spark, path)
    name = column if column is not None else longest_column(table)
    if name not in table.columns:
        raise ValidationError(f"no column {name!r}; there are {', '.join(table.columns)}")
    return _documents(table, name)


def _documents(table: DataFrame, name: str) -> DataFrame:
    value = trim(F.regexp_replace(F.col(f"`{name}`").cast("string"), r"\s*\n\s*", " "))
    return table.select(value.alias("text")).where("text <> ''")


def longest_column(table: DataFrame) -> str:
    """The column whose values are longest on average, of equals the first."""
    if not table.columns:
        raise ValidationError("the table has no columns")
    row = table.agg(*[F.avg(F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0))).alias(str(k)) for k, c in enumerate(table.columns)]).first()
    return table.columns[max(range(len(table.columns)), key=lambda k: (row[k] or 0.0, -k))]


def average_lengths(table: DataFrame) -> DataFrame:
    """``column, average``: mean length of each column's values as text, null as empty."""
    means = table.agg(*[F.avg(F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0))).alias(c) for c in table.columns])
    return means.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("average")) for c in table.columns])))


def preview(df: DataFrame, offset: int = 0, limit: int = 5000, text: str = "text") -> DataFrame:
    """``df`` with ``preview, total, hasMore``: a stretch of each text."""
    limit, offset = max(100, min(50_000, limit)), max(0, offset)
    t = F.col(text)
    return df.withColumns({"preview": F.substring(t, offset + 1, limit), "total": F.length(t), "hasMore": F.length(t) > offset + limit})


def preprocess_preview(df: DataFrame, config: dict[str, bool], text: str = "text", key: str | None = None, shown: int = 3000, refuse: bool = True) -> DataFrame:
    """Per text, without storing anything: ``steps, before, after, truncated``, after the ``key`` if one is named.

    ``before`` and ``after`` have characters, lines, words, distinct words and the beginning
    of the text.  Empty and null texts are refused, as a request's is; with ``refuse`` off, as
    for a whole table, they are rows too: an empty text has nothing of each, a null one nulls.
    """
    t = F.col(text)
    if refuse:
        t = F.when(F.coalesce(t, F.lit("")) == "", F.raise_error(F.lit("nothing to preprocess"))).otherwise(t)
    given = df.select(t.alias("__given"), *([F.col(key)] if key else []))
    rows = preprocess(given, config, "__given", "__made", "__r")

    def side(which: str, made: str) -> Column:
        r = F.col(f"__r.{which}")
        words = F.size(F.array_distinct(raw_words(F.col(made))))
        return F.struct(r["chars"].alias("chars"), r["lines"].alias("lines"), r["words"].alias("words"), words.alias("vocabulary"), F.substring(made, 1, shown).alias("preview"))

    return rows.select(*([key] if key else []), F.col("__r.steps").alias("steps"), side("before", "__given").alias("before"), side("after", "__made").alias("after"), (F.length("__given") > shown).alias("truncated"))


def export_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of all frames under the union of their columns, in order of first sight, as quoted CSV."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_payload(spark: SparkSession, title: str, rows: list[dict], path: str, form: str = "json") -> None:
    """Rows of a result that is not stored, the first MOST_PAYLOAD of them; in JSON under their title."""
    kept = rows[:MOST_PAYLOAD]
    names = list(dict.fromkeys(k for r in kept for k in r))
    text = lambda v: None if v is None else str(v)
    frame = spark.createDataFrame([tuple(text(r.get(k)) for k in names) for r in kept], ", ".join(f"`{k}` string" for k in names) or "none string")
    if form == "csv":
        export_csv([frame.coalesce(1)], path)
    else:
        whole = frame.agg(F.collect_list(F.struct(*[F.col(f"`{k}`") for k in names])).alias("rows"))
        export_json(whole.select(F.lit(title).alias("title"), F.current_timestamp().alias("exportedAt"), "rows"), path)


def report_rows(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per summary entry of each run, with its experiment's columns in front."""
    e = experiments.select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment"), "mode")
    rows = runs.select(F.col("id").alias("run_id"), "experiment_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("run_at"), F.explode("rows").alias("r"))
    return rows.join(e, "experiment_id").select("experiment_id", "experiment", "mode", "run_id", "run_at", "r.*")

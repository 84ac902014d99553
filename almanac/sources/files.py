"""File forms beside CSV and JSON: SQLite tables, workbooks of column blocks, landed CSV streams; reports and exports."""

from __future__ import annotations

import posixpath
import re
import sqlite3
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- sources


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file on the driver. The file goes to each executor once; each task reads a range of row ids, a
    chunk at a time."""
    if not re.fullmatch(r"\w+", table):
        raise ValueError(f"not a table's name: {table}")
    spark.sparkContext.addFile(path)
    name, columns = posixpath.basename(path), [f.name for f in T._parse_datatype_string(schema)]
    quoted = ", ".join(f'"{c}"' for c in columns)

    def run(batches):
        for batch in batches:
            con = sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True)
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {table}").fetchone()
            for k in batch["id"] if low is not None else []:
                step = -(-(high - low + 1) // parts)
                query = f"SELECT {quoted} FROM {table} WHERE rowid >= {low + k * step} AND rowid < {low + (k + 1) * step}"
                yield from pd.read_sql_query(query, con, chunksize=10_000, dtype=object)
            con.close()

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def read_blocks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, block, row, field, value) of workbooks whose first sheet has blocks of `width` columns side by side: a title in
    the first row, fields in the second, values below. A workbook is read by one task."""

    def cells(data) -> dict[tuple[int, int], str]:
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        with zipfile.ZipFile(data) as z:
            shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
            sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        out = {}
        for c in sheet.iter(f"{ns}c"):
            letters, number = re.fullmatch(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
            column = 0
            for x in letters:
                column = 26 * column + ord(x) - 64
            value = c.find(f"{ns}v")
            text = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
            out[int(number), column - 1] = shared[int(text)] if c.get("t") == "s" else text
        return out

    def run(batches):
        import io

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                found, rows = cells(io.BytesIO(content)), []
                for (r, c), value in sorted(found.items()):
                    if r > 2 and value:
                        first = c // width * width
                        rows.append((file, found.get((1, first), ""), r, found.get((2, c), ""), value))
                yield pd.DataFrame(rows, columns=["file", "block", "row", "field", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, block string, row int, field string, value string")


def stream_csv(spark: SparkSession, folder: str, schema: T.StructType, where: Column | None = None, files: int = 10) -> DataFrame:
    """CSV files as they land in a folder, so many in each batch; rows are filtered where they are read."""
    out = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(folder)
    return out if where is None else out.where(where)


# ---------------------------------------------------------------- reports and exports


def markdown(df: DataFrame, n: int = 20) -> str:
    """The first n rows as a Markdown table; bars in values are escaped."""
    rows = [[("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ") for v in r] for r in df.limit(n).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows]) + "\n"


def rebuild(df: DataFrame, path: str, refresh: bool) -> DataFrame:
    """A table that is made anew if refresh is set, and added to otherwise."""
    df.write.mode("overwrite" if refresh else "append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_groups(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """One CSV folder for each grouping column, with its values and their counts: one pass by grouping sets."""
    keys = [F.col(c).cast("string").alias(c) for c in columns]
    sets = df.select(*keys).groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        name, value = F.when(F.col(f"_{c}") == 0, c).otherwise(name), F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    out = sets.select(name.alias("grouping"), value.alias("value"), "n")
    out.write.mode("overwrite").partitionBy("grouping").csv(path, header=True)
    return out


def check_package(tables: dict[str, DataFrame], rows: dict[str, int], references: list[tuple[str, str, str, str]], ranges: list[tuple[str, str]]) -> DataFrame:
    """(problem, n): tables with fewer rows than wanted, references (table, column, to, key) that lead nowhere, conditions
    (table, condition) that rows break. Empty if all is well."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "problem string, n long")
    for name, least in rows.items():
        out = out.unionByName(tables[name].agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(f"{name} has too few rows").alias("problem"), "n"))
    for name, column, to, key in references:
        lost = tables[name].where(F.col(column).isNotNull()).join(tables[to].select(F.col(key).alias(column)), column, "left_anti")
        out = out.unionByName(lost.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(f"{name}.{column} is not in {to}").alias("problem"), "n"))
    for name, condition in ranges:
        broken = tables[name].where(~F.coalesce(F.expr(condition), F.lit(False)))
        out = out.unionByName(broken.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(f"{name}: not {condition}").alias("problem"), "n"))
    return out

"""An ad-hoc SQL console over registered views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import pandas_udf

from tessera.sources.readers import read_any

ROWS = 200
VIEWS = 24

# Statements that write files or attach databases, and those of this engine that change tables.
WRITES = (
    (r"(?is)\bcopy\b.*\bto\b", "Write a file from SQL"),
    (r"(?i)\bexport\s+database\b", "Export a database to files"),
    (r"(?i)\battach\b(?!\s+':memory:')", "Attach and modify a database file"),
    (r"(?is)^\s*insert\b", "Insert rows"),
    (r"(?is)^\s*(create|replace)\s+(or\s+replace\s+)?table\b", "Create a table"),
    (r"(?is)^\s*(drop|alter|truncate|delete|update|merge|load|refresh)\b", "Change a table"),
)


def write_reason(sql: str) -> str | None:
    """Why a statement needs approval, or None."""
    return next((label for pattern, label in WRITES if re.search(pattern, sql)), None)


def translated(sql: str) -> str:
    """Console idioms in this engine's words."""
    sql = re.sub(r"(?i)\bread_(?:csv|csv_auto)\(\s*'([^']*)'\s*\)", r"csv.`\1`", sql)
    sql = re.sub(r"(?i)\bread_(?:json|json_auto)\(\s*'([^']*)'\s*\)", r"json.`\1`", sql)
    sql = re.sub(r"(?i)\b(?:read_parquet|parquet_scan)\(\s*'([^']*)'\s*\)", r"parquet.`\1`", sql)
    sql = re.sub(r"(?i)\bstrftime\(\s*([^(),]+),\s*'%Y-%m'\s*\)", r"date_format(\1, 'yyyy-MM')", sql)
    sql = re.sub(r"(?i)\bstrftime\(\s*([^(),]+),\s*'%Y-%m-%d'\s*\)", r"date_format(\1, 'yyyy-MM-dd')", sql)
    sql = re.sub(r"(?i)\bquantile_cont\(\s*([^(),]+),\s*([0-9.]+)\s*\)", r"percentile_cont(\2) WITHIN GROUP (ORDER BY \1)", sql)
    sql = re.sub(r"(?i)\blist_transform\(", "transform(", sql)
    return re.sub(r"(?i)\blist_reduce\(", "reduce(", sql)


class Console:
    """One session's views; statements that write are refused unless allowed."""

    def __init__(self, spark: SparkSession, allow_writes: bool = False) -> None:
        self.spark, self.allow_writes = spark, allow_writes

    def register(self, name: str, path: str) -> DataFrame:
        table = read_any(self.spark, path)
        table.createOrReplaceTempView(name)
        return table

    def register_datasets(self, datasets: DataFrame, ids: list[int]) -> dict[str, list[tuple[str, str]]]:
        """Views kb_dataset_<id> of datasets (id, path), at most VIEWS at a time, with their columns."""
        wanted = [int(i) for i in ids][:VIEWS]
        out = {}
        for r in datasets.filter(datasets["id"].isin(wanted)).select("id", "path").collect():
            table = self.spark.read.parquet(r["path"])
            table.createOrReplaceTempView(f"kb_dataset_{r['id']}")
            out[f"kb_dataset_{r['id']}"] = table.dtypes
        return out

    def function(self, name: str, f: Callable, returns: str) -> None:
        """A function of the user's for this session's statements: it takes and gives whole columns, as pandas series."""
        self.spark.udf.register(name, pandas_udf(f, returns))

    def sql(self, statement: str) -> DataFrame:
        reason = write_reason(statement)
        if reason and not self.allow_writes:
            raise PermissionError(f"{reason}: this statement needs approval")
        if m := re.match(r"(?is)^\s*summarize\s+(.*)$", statement):
            from tessera.operators.profile import profile

            inner = m[1].strip().rstrip(";")
            return profile(self.spark.sql(translated(inner if re.match(r"(?i)(select|with|from)\b", inner) else f"SELECT * FROM {inner}")))
        return self.spark.sql(translated(statement))

    def show(self, statement: str, most: int = ROWS) -> str:
        """A header and at most `most` rows, tab-separated, with the honest total."""
        table = self.sql(statement)
        rows = table.limit(most + 1).collect()
        total = len(rows) if len(rows) <= most else table.count()
        note = f"{total} rows" if total <= most else f"{total} rows (first {most} shown)"
        return "\n".join(["\t".join(table.columns), *("\t".join("" if v is None else str(v) for v in r) for r in rows[:most]), note])


def dataset_path(datasets: DataFrame, key: str | int) -> str:
    """Where a dataset's Parquet lies; an id that is no number or not known is an error."""
    if not str(key).isdigit():
        raise LookupError(f"no dataset {key}")
    found = datasets.filter(datasets["id"] == int(key)).select("path").head()
    if found is None:
        raise LookupError(f"no dataset {key}")
    return found["path"]

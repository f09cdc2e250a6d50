"""Personal trade journals in CSV with free header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: accepted header names, best first (fixed values)
DATE_HEADERS = ("entry_date", "date", "open_date", "entry")
SYMBOL_HEADERS = ("symbol", "ticker")


def _header(columns: list[str], wanted: tuple[str, ...]) -> str | None:
    plain = {c.strip().lower().replace(" ", "_"): c for c in columns}
    return next((plain[n] for n in wanted if n in plain), None)


def normalize_journal(raw: DataFrame, symbol: str | None) -> DataFrame:
    """Rename the date column to `entry_date`, parse it and keep the symbol's rows.

    A row with a blank symbol passes; a date that does not parse stops the job.
    """
    date_col = _header(raw.columns, DATE_HEADERS)
    if date_col is None:
        raise ValueError(f"the journal needs one of the columns {DATE_HEADERS}")
    d = raw.withColumnRenamed(date_col, "entry_date")
    parsed = F.col("entry_date").try_cast("date")
    bad = F.raise_error(F.concat(F.lit("invalid entry_date: "), F.coalesce(F.col("entry_date").cast("string"), F.lit("(blank)"))))
    d = d.withColumn("entry_date", F.coalesce(parsed, bad.cast("date")))
    symbol_col = _header(raw.columns, SYMBOL_HEADERS)
    if symbol_col is not None and symbol is not None:
        s = F.upper(F.trim(F.coalesce(F.col(f"`{symbol_col}`").cast("string"), F.lit(""))))
        d = d.where((s == symbol.upper()) | s.isin("", "NAN"))
    return d


def read_journal(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return normalize_journal(spark.read.csv(path, header=True), symbol)

"""Sinks. Tables go to Parquet; the others are for people and other programs."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Header CSV without an index, columns in declared order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


#: The most rows of a result that comes to the driver as one file or table.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL):
    """All rows as a pandas frame; more than ``most`` raise instead of filling the driver."""
    found = df.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write them as CSV or Parquet")
    return found


def _small_rows(df: DataFrame, most: int = SMALL) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as CSV or Parquet")
    return rows


def bom_csv(df: DataFrame, path: str) -> None:
    """One CSV file for spreadsheets, with a byte order mark; for small results, which come to the driver."""
    small(df).to_csv(path, index=False, encoding="utf-8-sig")


def arrays(df: DataFrame, path: str, *partition: str) -> None:
    """Logits, labels and masks as array columns keyed by row, never by position."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def once(df: DataFrame, path: str, *partition: str) -> None:
    """A bulk load that does nothing where the table exists."""
    writer = df.write.mode("ignore")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """A run log: every batch of attempts is appended, and finished keys are read back with an anti-join."""
    df.write.mode("append").parquet(path)


def nested_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, null fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(column))


def without_stamps(df: DataFrame) -> DataFrame:
    """The frame less its time columns and those named as such."""
    return df.select(*[f.name for f in df.schema.fields if f.dataType.typeName() not in ("timestamp", "timestamp_ntz") and f.name not in ("created_at", "updated_at")])


def atomic_json(value: dict, path: str) -> None:
    """A small state file of the driver: written beside its place, then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, sort_keys=True)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def summary_json(df: DataFrame, path: str, **more) -> dict:
    """The first row of a summary, with more entries, as a JSON file."""
    row = df.first()
    value = (row.asDict(recursive=True) if row else {}) | more
    atomic_json(value, path)
    return value


_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def latex(df: DataFrame, caption: str, label: str, digits: int = 3) -> str:
    """A booktabs table of a small result."""

    def cell(x) -> str:
        if x is None:
            return "--"
        return f"{x:.{digits}f}" if isinstance(x, float) else "".join(_TEX.get(c, c) for c in str(x))

    rows = [" & ".join(cell(x) for x in r) + r" \\" for r in map(tuple, _small_rows(df))]
    kinds = "".join("r" if f.dataType.typeName() in ("double", "float", "long", "integer", "decimal") else "l" for f in df.schema.fields)
    head = " & ".join(cell(c) for c in df.columns) + r" \\"
    lines = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{kinds}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines) + "\n"


def paper_table(df: DataFrame, folder: str, stem: str, caption: str) -> tuple[str, str]:
    """A LaTeX table and its CSV twin."""
    os.makedirs(folder, exist_ok=True)
    tex, twin = f"{folder}/{stem}.tex", f"{folder}/{stem}.csv"
    with open(tex, "w", encoding="utf-8") as f:
        f.write(latex(df, caption, f"tab:{stem}"))
    small(df).to_csv(twin, index=False)
    return tex, twin

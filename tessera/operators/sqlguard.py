"""Ad-hoc questions: one reading SQL statement with a limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words that change something; refused outside quotes (fixed values).
FORBIDDEN = "insert update delete merge drop create alter truncate replace grant revoke load copy export import call set reset cache uncache refresh analyze use add remove".split()


class Refused(ValueError):
    """The statement is not a single reading query."""


def checked(text: str) -> str:
    """The statement without trailing semicolon, or Refused with the reason."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "''", bare).strip().rstrip(";").strip()
    if not bare:
        raise Refused("there is no statement")
    if ";" in bare:
        raise Refused("one statement at a time")
    words = re.findall(r"[A-Za-z_]+", bare.lower())
    if words[0] not in ("select", "with", "values", "table", "from"):
        raise Refused(f"a statement that reads begins with SELECT or WITH, not {words[0].upper()}")
    if found := [w for w in words if w in FORBIDDEN and w != "replace"]:
        raise Refused(f"{found[0].upper()} changes something")
    return text.strip().rstrip(";").strip()


def read_only_sql(spark: SparkSession, text: str, limit: int = 100, **tables: DataFrame) -> DataFrame:
    """The rows of one reading statement over ``tables``, at most ``limit``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(checked(text)).limit(limit)

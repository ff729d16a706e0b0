"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.operators.storage import shared_folder  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a maximal run of bytes outside the six ASCII white-space characters.
SPACES = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as Parquet below ``folder`` and read again: the lineage ends
    here, and the files survive the loss of any executor."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the rows no classifier learns from: crc32 of the id as text is 2 modulo 4.
    A null id has no text and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {df.columns}")


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has at most ``rows`` rows; else the planner's choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

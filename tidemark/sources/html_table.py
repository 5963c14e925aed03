"""Tables in HTML pages: every cell, and the one observation table of a station page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = re.compile(r"<(tr|li)\b[^>]*>(.*?)(?=</?(?:tr|li|table|ul|ol)\b|\Z)", re.I | re.S)
_CELL = re.compile(r"<(?:td|th)\b[^>]*>(.*?)(?=</?(?:td|th|tr|table)\b|\Z)", re.I | re.S)
_TAG = re.compile(r"<[^>]*>")


def _text(raw: str) -> str:
    return " ".join(html.unescape(_TAG.sub(" ", raw)).split())


def cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, row_number, cell_number, value) of every table row and list item; null pages have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, page in zip(batch[id_col], batch[html_col], strict=True):
                for r, found in enumerate(_ROW.finditer(page or "")):
                    values = [_text(c) for c in _CELL.findall(found[2])] or [_text(found[2])]
                    out += [(key, r, c, v) for c, v in enumerate(values)]
            yield pd.DataFrame(out, columns=[id_col, "row_number", "cell_number", "value"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(read, f"{id_col} {kind}, row_number int, cell_number int, value string")


def observations(page: str) -> list[dict]:
    """Rows of the only table in the daily-observations section of a station page, by header.

    Raises ValueError unless there is exactly one such table and its unit is °F.
    """
    section = re.search(r'data-results="?observations"?[^>]*>(.*?)(?:</section>|\Z)', page, re.I | re.S)
    heading = section and re.search(r"<h2[^>]*>\s*daily observations\s*</h2>(.*)", section[1], re.I | re.S)
    tables = re.findall(r"<table\b.*?</table>", heading[1], re.I | re.S) if heading else []
    if len(tables) != 1:
        raise ValueError(f"{len(tables)} observation tables")
    rows = [[_text(c) for c in _CELL.findall(r[1])] for r in _ROW.findall(tables[0])]
    rows = [r for r in rows if r]
    if not rows or "°C" in tables[0] or "°F" not in _text(tables[0]):
        raise ValueError("the table has no rows in °F")
    names = [re.sub(r"[^a-z]+", "_", h.lower()).strip("_") for h in rows[0]]
    return [dict(zip(names, r, strict=False)) for r in rows[1:]]


def one_identity(pages: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, consistent): whether all parts of a page name the same station, zone, mode and date."""
    return pages.groupBy(*keys).agg((F.countDistinct(F.struct(*fields)) == 1).alias("consistent"))


def temperature(value: Column) -> Column:
    """The number of a cell such as "72 °F"; other units are null."""
    return F.nullif(F.regexp_extract(value, r"^\s*(-?\d+(?:\.\d+)?)\s*°?\s*F?\s*$", 1), F.lit("")).try_cast("double")

"""Rows out of stored result pages: a small standard-library parser inside mapInPandas."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class Cells(HTMLParser):
    """The cells' texts of every table row."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.rows[-1][-1] += data.strip()


def cells(html: str | None) -> list[list[str]]:
    parser = Cells()
    parser.feed(html or "")
    return [r for r in parser.rows if r]


def html_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row, cells map by header name, n_rows): table rows by the names in the first one; a page without a table gives one row with row null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"]):
                head, *rows = cells(html) or [[]]
                out += [(page, i, dict(zip(head, r)), len(rows)) for i, r in enumerate(rows)] or [(page, None, {}, 0)]
            yield pd.DataFrame(out, columns=["page_id", "row", "cells", "n_rows"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row int, cells map<string,string>, n_rows int")


def html_pedigree(pages: DataFrame) -> DataFrame:
    """(page_id, sire, dam, broodmare_sire, status) of pedigree pages: rows 0 and 16 begin with sire and dam; fewer than 17 rows fail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"]):
                rows = cells(html)
                good = len(rows) >= 17 and len(rows[16]) > 1
                out.append((page, rows[0][0], rows[16][0], rows[16][1], "fetched") if good else (page, None, None, None, "failed"))
            yield pd.DataFrame(out, columns=["page_id", "sire", "dam", "broodmare_sire", "status"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, sire string, dam string, broodmare_sire string, status string")

"""A self-contained HTML report; tables are cut to their first rows, with a note that says so."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


class Report:
    def __init__(self, title: str, rows: int = 200):
        self.title, self.rows, self.parts = title, rows, []

    def section(self, text: str) -> None:
        self.parts.append(f"<h2>{escape(text)}</h2>")

    def note(self, text: str) -> None:
        self.parts.append(f"<p>{escape(text)}</p>")

    def table(self, df: DataFrame) -> None:
        found = df.limit(self.rows + 1).collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in found[: self.rows])
        self.parts.append(f"<table><tr>{head}</tr>{body}</table>")
        if len(found) > self.rows:
            self.note(f"First {self.rows} rows.")

    def render(self) -> str:
        return f'<!doctype html><meta charset="utf-8"><title>{escape(self.title)}</title><h1>{escape(self.title)}</h1>' + "".join(self.parts)

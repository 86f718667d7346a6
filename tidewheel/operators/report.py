"""Small result tables as text: phenotype names and an HTML report."""

from __future__ import annotations

import base64
import html
import mimetypes
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Header colours of the groups P0, P1, ...
GROUP_COLOURS = ("#d9e8f6", "#f9e0d2", "#dcefd9", "#ece0f3")


@dataclass(frozen=True)
class Section:
    """A titled section: a note and one table, or several under titles of their own; tables that are None are left out."""

    title: str
    tables: tuple[tuple[str | None, DataFrame | None], ...]
    note: str = ""

    @property
    def shown(self) -> list[tuple[str | None, DataFrame]]:
        return [(t, df) for t, df in self.tables if df is not None]


def before_after(title: str, before: DataFrame | None, after: DataFrame | None, change: DataFrame | None = None, note: str = "", names: tuple[str, str, str] = ("Before", "After", "Change")) -> Section:
    """A section of up to three tables, numbered below its own number, each by its p-value if it has one."""
    by_p = lambda df: df.orderBy(F.col("p_value").asc_nulls_last()) if df is not None and "p_value" in df.columns else df
    return Section(title, tuple((n, by_p(df)) for n, df in zip(names, (before, after, change), strict=True)), note)


def study(title: str, sections: list[Section], footer: str = "", facts: dict[str, object] | None = None) -> Report:
    """A report of a study's sections in the caller's order; the first needs a table, others without one are left out, and numbers follow those that are there.

    ``facts`` stand below the title, such as the numbers of entities and groups.
    """
    if not sections or not sections[0].shown:
        raise ValueError("a report's first section needs a table")
    return Report(title, [s for s in sections if s.shown], footer=footer, facts=facts or {})


def display_columns(df: DataFrame) -> list[str]:
    """The columns that are shown: all but counts named N or n."""
    return [x for x in df.columns if x.lower() != "n"]


@dataclass
class Report:
    """Titled, numbered sections of result tables, whole; only the title is a must.

    Tables of a report are small by their nature: a row for each group, feature or test.  Rows are read one partition at a time.
    """

    title: str
    sections: list[Section] = field(default_factory=list)
    images: list[tuple[str, str]] = field(default_factory=list)
    footer: str = ""
    facts: dict[str, object] = field(default_factory=dict)

    def add(self, title: str, table: DataFrame | None, note: str = "") -> Report:
        if table is not None:
            self.sections.append(Section(title, ((None, table),), note))
        return self

    def pieces(self) -> Iterator[str]:
        """The report, a row of a table at a time."""
        text = lambda x: html.escape(str(x))
        yield f"<!DOCTYPE html><html><meta charset='utf-8'><body><h1>{text(self.title)}</h1>"
        if self.facts:
            yield "<p>" + "<br>".join(f"<b>{text(k)}:</b> {text(v)}" for k, v in self.facts.items()) + "</p>"
        for i, section in enumerate(self.sections, 1):
            yield f"<h2>{i}. {text(section.title)}</h2>" + (f"<p>{text(section.note)}</p>" if section.note else "")
            for k, (title, table) in enumerate(section.shown, 1):
                if title is not None:
                    yield f"<h3>{i}.{k} {text(title)}</h3>"
                yield "<table><tr>" + "".join(self._head(x) for x in table.columns) + "</tr>"
                for row in table.toLocalIterator():
                    yield "<tr>" + "".join(f"<td>{'' if x is None else text(x)}</td>" for x in row) + "</tr>"
                yield "</table>"
        for title, path in self.images:
            yield f"<figure><img alt='{text(title)}' src='{embed(path)}'></figure>"
        yield f"<footer>{text(self.footer)}</footer></body></html>"

    @staticmethod
    def _head(name: str) -> str:
        colour = next((f" style='background:{x}'" for i, x in enumerate(GROUP_COLOURS) if name == f"P{i}"), "")
        return f"<th{colour}>{html.escape(name)}</th>"

    def render(self) -> str:
        return "".join(self.pieces())

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(self.pieces())


def embed(path: str) -> str:
    """An image as a data URI; a missing file is the empty text."""
    if not os.path.exists(path):
        return ""
    with open(path, "rb") as f:
        return f"data:{mimetypes.guess_type(path)[0] or 'image/png'};base64,{base64.b64encode(f.read()).decode()}"


def phenotype_names(features: DataFrame, by: str = "phenotype") -> DataFrame:
    """(phenotype, name): burden in per cent, episodes and duration of each phenotype's mean."""
    m = features.groupBy(by).agg(F.avg("af_burden_percent").alias("b"), F.avg("n_episodes").alias("n"), F.avg("mean_episode_duration").alias("d"))
    return m.select(by, F.format_string("P%d: %.1f%% burden - %.0f episodes - %.0f min", F.col(by).cast("int"), "b", "n", "d").alias("name"))

"""Printed tables: result tables with sections, labels, blank lines and headers, as rows of text."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episcope.operators.clean import mapping_value


@dataclass(frozen=True)
class Layout:
    """What a printed table looks like.

    ``sections`` and ``rows`` map wanted values of the two key columns to labels, in printed order; other values are not
    printed. ``columns`` maps value columns to headers. With one header for both keys (``row_header`` equal to
    ``section_header``) the section's name stands above its rows, else in a column of its own. ``rows_of`` gives the rows
    of a section that has others than ``rows``. ``every_row`` prints rows without data too, with ``missing`` in each
    cell; else they are left out, as an empty section's rows are.
    """

    section: str
    row: str
    sections: Mapping
    rows: Mapping
    columns: Mapping[str, str]
    section_header: str = "Section"
    row_header: str = "Group"
    missing: str = "—"
    spacer: bool = True
    every_row: bool = False
    rows_of: Mapping = field(default_factory=dict)

    def skeleton(self) -> list[tuple]:
        """Position, kind of line, section, row and label of every line."""
        out = []
        for section, title in self.sections.items():
            out.append((len(out), "title", section, None, title))
            out += [(len(out) + i, "row", section, value, label)
                    for i, (value, label) in enumerate(self.rows_of.get(section, self.rows).items())]
            if self.spacer:
                out.append((len(out), "blank", None, None, ""))
        return out


def printed(table: DataFrame, layout: Layout) -> DataFrame:
    """The lines of a printed table; ``position`` carries their order.

    ``table`` has one row per section and row value (of several, cells take their largest text). The wanted lines are
    literals of the layout, so the table is filtered by them, reduced, and joined to a handful of lines.
    """
    spark = table.sparkSession
    lines = spark.createDataFrame(layout.skeleton(), "position long, __kind string, __section string, __row string, __label string")
    wanted = F.col(layout.section).cast("string").isin([str(s) for s in layout.sections])
    cells = table.where(wanted).groupBy(F.col(layout.section).cast("string").alias("__section"),
                                        F.col(layout.row).cast("string").alias("__row")).agg(
        *[F.max(F.col(c).cast("string")).alias(f"__{i}") for i, c in enumerate(layout.columns)], F.lit(True).alias("__found"))
    joined = F.broadcast(lines).join(cells, ["__section", "__row"], "left")  # the layout's own lines
    is_row, is_title = F.col("__kind") == "row", F.col("__kind") == "title"
    if not layout.every_row:
        joined = joined.where(~is_row | F.col("__found"))
    label = F.col("__label")
    if layout.section_header == layout.row_header:
        heads = [label.alias(layout.row_header)]
    else:
        heads = [F.when(is_title, label).otherwise("").alias(layout.section_header),
                 F.when(is_row, label).otherwise("").alias(layout.row_header)]
    return joined.select("position", *heads, *[
        F.when(is_row, F.coalesce(F.col(f"__{i}"), F.lit(layout.missing))).otherwise("").alias(header)
        for i, header in enumerate(layout.columns.values())])


def relabelled(table: DataFrame, columns: Mapping[str, str], values: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Chosen columns in printed order under their headers; listed values get their label, others stay as they are."""
    def shown(c: str) -> Column:
        return mapping_value(c, values[c], F.col(c)) if values and c in values else F.col(c)

    return table.select(*[shown(c).alias(header) for c, header in columns.items()])

"""Coverage levels, distributions, heatmap cells and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (level, least documents), strongest first; below the last is a gap.
LEVELS = (("heavy", 8), ("strong", 4), ("reinforced", 2), ("introduced", 1))


def level_of(docs: Column) -> Column:
    out = F.lit("gap")
    for name, least in reversed(LEVELS):
        out = F.when(docs >= least, F.lit(name)).otherwise(out)
    return out


def distribution(docs: Column, total: Column) -> list[Column]:
    """Aggregates of a group of topics with document counts against the size of the whole catalog."""
    addressed = F.count_if(docs > 0)
    return [
        F.max(total).alias("total"),
        addressed.alias("addressed"),
        F.count_if(docs >= 2).alias("substantive"),
        F.greatest(F.lit(0), F.max(total) - addressed).alias("gap"),
        *(F.count_if(level_of(docs) == name).alias(name) for name, _ in reversed(LEVELS)),
    ]


#: The same in SQL over a table with columns docs and total.
DISTRIBUTION_SQL = "max(total) AS total, count(*) FILTER (docs > 0) AS addressed, count(*) FILTER (docs >= 2) AS substantive, greatest(0, max(total) - count(*) FILTER (docs > 0)) AS gap, count(*) FILTER (docs = 1) AS introduced, count(*) FILTER (docs BETWEEN 2 AND 3) AS reinforced, count(*) FILTER (docs BETWEEN 4 AND 7) AS strong, count(*) FILTER (docs >= 8) AS heavy"
LEVEL_SQL = "CASE WHEN docs >= 8 THEN 'heavy' WHEN docs >= 4 THEN 'strong' WHEN docs >= 2 THEN 'reinforced' WHEN docs >= 1 THEN 'introduced' ELSE 'gap' END"


def heatmap_cell(touched: Column, total: Column) -> Column:
    known = (F.coalesce(touched, F.lit(0)) > 0) & (F.coalesce(total, F.lit(0)) > 0)
    return F.when(~known, "gap").when(touched / F.nullif(total, F.lit(0)) >= 0.5, "covered").otherwise("partial")


#: The sentences on a distribution.
NO_TOPICS = "No framework domains to report yet."
NONE_ADDRESSED = "0 of %d domains addressed — no documents aligned yet."
ALL_ADDRESSED = "All %d domains addressed."
SOME_ADDRESSED = "%d of %d domains addressed; %d need attention."


def spectrum_sentence(addressed: Column, total: Column, gap: Column) -> Column:
    return (
        F.when(total <= 0, F.lit(NO_TOPICS)).when(addressed == 0, F.format_string(NONE_ADDRESSED, total))
        .when(gap == 0, F.format_string(ALL_ADDRESSED, total)).otherwise(F.format_string(SOME_ADDRESSED, addressed, total, gap))
    )


#: The sentences on domains and on the grid of cases by systems.
NO_DOMAINS = "No AAMC domain data yet."
NO_CELLS = "No sessions or systems to show yet."
NO_GAP_CELLS = "Every session touches every in-scope system."
GAP_CELLS = "%d of %d session × system cells show no coverage yet."


def grid_sentence(gaps: Column, cells: Column) -> Column:
    return F.when(cells == 0, F.lit(NO_CELLS)).when(gaps == 0, F.lit(NO_GAP_CELLS)).otherwise(F.format_string(GAP_CELLS, gaps, cells))

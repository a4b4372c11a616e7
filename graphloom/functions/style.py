"""Icons, colours, shapes and line styles of categories and relations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Icon, red, green, blue and shape of each category, then of any other.
CATEGORY = {
    "SceneComponent": ("view_in_ar", 0.18, 0.80, 0.44, "RoundedBox"),
    "UiPanel": ("dashboard", 0.20, 0.60, 1.0, "Circle"),
    "UiPanelComponent": ("dashboard", 0.20, 0.60, 1.0, "Circle"),
    "GameResource": ("inventory_2", 0.95, 0.77, 0.06, "Ring"),
    "Interface": ("extension", 0.61, 0.35, 0.71, "Hexagon"),
    "Struct": ("data_object", 0.90, 0.49, 0.13, "Circle"),
    "Enum": ("list", 0.10, 0.74, 0.61, "Diamond"),
}
CATEGORY_OTHER = ("code", 0.55, 0.60, 0.70, "Circle")
# Label, red, green, blue, alpha, line style and speed of each relation, then of any other.
RELATION = {
    "Inherits": ("inherits", 0.91, 0.30, 0.24, 0.8, "DirectionalArrows", 1.2),
    "Implements": ("implements", 0.91, 0.30, 0.24, 0.8, "DirectionalArrows", 1.2),
    "RazorMarkupTag": ("<tag />", 1.0, 0.62, 0.26, 0.8, "DoubleLine", 0.0),
    "EventSubscription": ("+=", 0.68, 0.38, 0.95, 0.8, "LaserPulse", 2.0),
    "Instantiates": ("new", 0.18, 0.80, 0.44, 0.7, "Dashed", 1.0),
}
RELATION_OTHER = (None, 0.35, 0.42, 0.55, 0.45, "Solid", 0.0)


def _styles(key: Column, table: dict, other: tuple, fields: list[str]) -> dict[str, Column]:
    """A column for each field: a chain of conditions over a dimension of a few rows, without a join."""
    out = {}
    for i, field in enumerate(fields):
        chain = F
        for value in dict.fromkeys(row[i] for row in table.values()):
            chain = chain.when(key.isin([k for k, row in table.items() if row[i] == value]), F.lit(value))
        out[field] = chain.otherwise(F.lit(other[i]))
    return out


def category_style(category: Column) -> dict[str, Column]:
    return _styles(category, CATEGORY, CATEGORY_OTHER, ["icon", "red", "green", "blue", "shape"])


def relation_style(kind: Column) -> dict[str, Column]:
    return _styles(kind, RELATION, RELATION_OTHER, ["label", "red", "green", "blue", "alpha", "line", "speed"])

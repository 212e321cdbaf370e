"""The queries over dependencies once more, over every step: no floor of confidence, in the query and in its SQL."""

from __future__ import annotations

from sedimenta.operators import graph, store  # noqa: F401  (registers what is repeated here)
from sedimenta.plans.projection import ALL_DEPENDS_SQL, DEPENDS_SQL
from sedimenta.plans.registry import FUNCTIONS, SQL, Tables, query

NAMES = (
    "g07_impact_closure", "a14_impact_summary", "a15_dependents_by_file", "g06_file_neighborhood", "g10_risk", "g16_overview",
    "g08_impact_report", "t09_dependents_order", "v01_top_edges_per_source", "v06_dependents_split", "v10_neighborhood_columns", "v11_hide_node",
)


def _whole(name: str) -> None:
    @query(f"{name}_all", SQL[name].replace(DEPENDS_SQL, ALL_DEPENDS_SQL))
    def run(t):
        return FUNCTIONS[name](Tables(t.spark, t.folder, floor=None))


for _name in NAMES:
    _whole(_name)

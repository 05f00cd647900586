"""Connected components whose intermediate edges are stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spate.llm.common import stage
from spate.operators import components as shared


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component = least id of the component."""
    return shared.components(edges, lambda df: stage(df, "components"))

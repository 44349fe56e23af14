"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.connectivity import label_edges


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(node, component)``, component being the smallest
    node reachable. Only nodes with an edge to another node are returned. Always by rounds over
    tables: links of documents are never gathered into one task."""
    return label_edges(edges, one_task=0, tag=tag)

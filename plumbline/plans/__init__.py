"""Plan-level helpers shared by the operators: lineage cuts, global ranks, graph components."""

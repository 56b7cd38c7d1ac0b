"""Plan helpers shared by the operators: lineage cuts and graph components."""

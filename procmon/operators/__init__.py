"""DataFrame operators, grouped by stage of the monitoring workflow."""

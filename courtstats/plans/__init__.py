"""Plans: driver-table views, award pipelines and the query catalogue."""

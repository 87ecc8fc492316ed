"""Matrix algebra on long tables, experiment pipelines, searches and the query catalogue."""

"""rillgrid: DataFrame-first operators for record flows, scoring, batch jobs and sampled traces."""

"""Record-level lineage for Spark jobs, and analysis of what each record did."""

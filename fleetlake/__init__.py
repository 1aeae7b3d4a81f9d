"""Equipment health analytics on Spark: versioned tables, feature stages, remaining-life models, quality and health queries."""

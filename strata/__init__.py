"""strata: operators for a layered, continuously updated data warehouse on Spark."""

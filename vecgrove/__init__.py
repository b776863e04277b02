"""Vector similarity joins, hash filters and group-testing recovery as Spark DataFrame plans."""

"""Transit and route analytics as Spark DataFrame transformations."""

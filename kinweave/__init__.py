"""Record linkage and entity resolution as composable Spark DataFrame transformations."""

"""Financial documents, ledgers and statements as composable Spark DataFrame transformations."""

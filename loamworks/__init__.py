"""loamworks: composable Spark DataFrame operators for web-data refining."""

"""costlake: cloud-cost analytics as composable PySpark DataFrame operators."""

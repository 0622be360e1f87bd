"""forecourt: vehicle-listing analytics as composable PySpark DataFrame functions."""

"""tallyforge: reconcile noisy, overlapping observations into one inventory, on PySpark."""

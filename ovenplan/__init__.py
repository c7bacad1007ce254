"""Production planning and recipe costing for make-to-order food, as PySpark DataFrame operators."""

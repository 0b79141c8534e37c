"""Murmuration: coordinated-activity analytics as PySpark DataFrame plans."""

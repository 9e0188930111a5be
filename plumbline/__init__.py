"""plumbline: claim grounding and text analytics as PySpark DataFrame operators."""

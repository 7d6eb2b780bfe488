"""plumbline: dataset audit and model-evaluation analytics as Spark plans."""

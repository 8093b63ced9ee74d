"""plumbline: uncertainty-quantification and corpus analytics as Spark DataFrame operators."""

"""Code-dependency and change-impact analytics as Spark jobs over tables."""

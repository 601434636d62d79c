"""quarry: graph mining and corpus preparation as PySpark DataFrame programs."""

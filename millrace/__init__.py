"""millrace: versioned key-value logs and corpus preparation as PySpark plans."""

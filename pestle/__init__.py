"""pestle: molecule, descriptor-table and fingerprint analytics on PySpark."""

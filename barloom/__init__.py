"""barloom: daily equity data and factor research as PySpark DataFrame jobs."""

"""Item-bank and assessment analytics on PySpark: every operator is a DataFrame -> DataFrame function."""

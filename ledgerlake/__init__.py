"""Bank management reporting on Spark: report ingest, warehouse loads and analytics.

Every public function takes DataFrames and returns a DataFrame; nothing here starts a session.
"""

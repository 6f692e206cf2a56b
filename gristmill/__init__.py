"""gristmill: web-corpus analytics as PySpark DataFrame programs."""

"""A PySpark analytics engine over file-system, chunk and blob relations."""

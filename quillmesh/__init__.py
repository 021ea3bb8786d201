"""Part of quillmesh, a Spark-first analytics engine."""

"""quadrille: a Spark-first engine for tables with two-dimensional points."""

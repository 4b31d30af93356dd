"""Time-ordered vector analytics on Spark: sources, operators, plans and sinks."""

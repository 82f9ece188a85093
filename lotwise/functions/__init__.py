"""Column expressions and name rules; no Spark jobs are started here."""

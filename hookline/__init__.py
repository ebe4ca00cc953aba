"""hookline: URL-risk analytics as PySpark jobs.

functions/  Column builders (URL parse and features, brand distance, HTML
            content, rules, label maps)
sources/    the given tables, tables derived from them, loaders and sinks
operators/  DataFrame jobs (feature job, enrichment joins, ranking, splits,
            metrics, Spark ML, scoring)
streaming/  Structured Streaming scoring and windows
plans/      the registered query catalog and its DuckDB oracle SQL
"""

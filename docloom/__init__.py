"""docloom: analytics over document knowledge bases, written as Spark DataFrame pipelines."""

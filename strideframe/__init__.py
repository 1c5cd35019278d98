"""strideframe: motion and signal analytics as Spark DataFrame pipelines."""

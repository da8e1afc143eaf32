"""The four document pipelines and the queries over them."""

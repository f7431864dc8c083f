"""Plan helpers and composed pipelines."""

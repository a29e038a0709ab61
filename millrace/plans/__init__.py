"""Tables, SQL views, pipelines and the relational catalogue."""

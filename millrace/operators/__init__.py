"""Row operators: projection, repair, inference, modules, capabilities."""

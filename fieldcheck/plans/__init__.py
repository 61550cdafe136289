"""Reports and jobs composed of operators: the user-level API."""

"""Planning: pure functions from a model and a request to a plan of plain dictionaries."""

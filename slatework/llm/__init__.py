"""Training-data operators tagged llm. Nothing else in the library imports this subpackage."""

"""Training-data operators for language models; nothing else in the library imports this subpackage."""

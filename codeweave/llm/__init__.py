"""Training-data operators. Nothing else in codeweave imports this subpackage."""

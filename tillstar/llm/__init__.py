"""Training-data operators and their pipeline. Nothing else in the library
imports this subpackage; it imports general helpers only."""

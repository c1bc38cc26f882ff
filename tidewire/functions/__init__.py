"""Column functions for addresses, protocols and text."""

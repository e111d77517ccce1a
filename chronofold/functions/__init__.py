"""Subpackage of chronofold."""

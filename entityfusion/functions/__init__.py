"""Subpackage of entityfusion."""

"""Operators that turn raw documents, pages and conversations into training data."""

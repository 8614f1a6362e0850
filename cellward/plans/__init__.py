"""Whole queries built from the operators; ``registry`` lists them with their SQL twins."""

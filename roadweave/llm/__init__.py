"""Operators for preparing training text: scoring, mixing, de-duplication, decontamination,
token files and secret scanning. Nothing else in the library imports this subpackage."""

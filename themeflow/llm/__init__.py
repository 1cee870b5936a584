"""Operators for preparing large training corpora (optional subpackage).

Nothing else in the library imports it; its queries are in
``themeflow.llm.queries``."""

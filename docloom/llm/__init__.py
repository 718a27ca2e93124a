"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` registers
the thin driver queries on top of them. Nothing outside this subpackage
imports it.
"""

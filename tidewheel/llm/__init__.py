"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` registers one production query per operator.
"""

"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the digest columns the
registered queries return.
"""

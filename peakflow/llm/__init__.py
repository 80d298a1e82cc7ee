"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. ``registry`` holds the queries and
their SQL twins; ``__spark_entry__.py`` picks them up when the subpackage is
there.
"""

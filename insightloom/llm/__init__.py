"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Every operator works on whole
tables; batch workers talk Arrow, plain expressions stay in Catalyst.
"""

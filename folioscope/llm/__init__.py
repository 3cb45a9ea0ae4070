"""Operators for preparing language-model training text.

Nothing outside this folder imports it; the driver entry adds its queries only
when the folder is present.
"""

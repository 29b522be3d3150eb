"""Operators for preparing training text: language, toxicity, lists, sketches, packing.

One module per operator; ``queries`` registers them. Nothing outside this
subpackage imports it, except the guarded lines of the driver entry.
"""

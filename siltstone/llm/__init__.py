"""Training-data operators: archives, filters, near-duplicates, mixing and packing.

Nothing outside this folder imports it.  ``siltstone.llm.queries`` registers
the driver queries.
"""

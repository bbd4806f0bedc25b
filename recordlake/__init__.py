"""recordlake: messy register extracts in, a clean and searchable record table out.

Every operator is a plain function from DataFrame (or Column) to DataFrame (or
Column); nothing runs until the caller acts on the result.
"""

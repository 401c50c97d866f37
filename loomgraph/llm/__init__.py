"""Training-data pipeline operators: cleaning, scanning, scoring, deduplication, search and packing.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame, reads only the columns
that it is told to read (so extra columns, whatever their names, never clash with its own) and returns a new
DataFrame.  ``queries`` holds the thin ``opN_`` queries over the shared tables.
"""

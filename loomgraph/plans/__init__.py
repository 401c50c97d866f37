"""From query text to algebra: parsing, views, paths, printing."""

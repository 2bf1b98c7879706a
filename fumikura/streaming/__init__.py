"""The row-wise filters on streams of lines."""

"""Operators for preparing training text; ``registry`` gathers their queries."""

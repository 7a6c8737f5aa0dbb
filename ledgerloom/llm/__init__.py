"""Operators that prepare page text for language models. Nothing else in the library imports them."""

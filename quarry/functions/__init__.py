"""Expressions on columns."""
from quarry.functions.text import STOP_WORDS, alnum_tokens, ascii_upper, clean, highlight, is_valid, query_fields, sketch_tokens, space_tokens, split_long, tokens

__all__ = ["STOP_WORDS", "alnum_tokens", "ascii_upper", "clean", "highlight", "is_valid", "query_fields", "sketch_tokens", "space_tokens", "split_long", "tokens"]

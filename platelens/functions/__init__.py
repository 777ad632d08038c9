"""Column expressions. Everything here is a native Spark expression (no UDF),
so it runs inside whole-stage codegen."""

from .text import (clean_item_name, label, number_text,
                   split_words, strip_ws)
from .numeric import coerce_numeric, is_number_text

__all__ = ["clean_item_name", "label", "number_text",
           "split_words", "strip_ws", "coerce_numeric", "is_number_text"]

"""Column functions."""

from wildloom.functions.like import any_like, first_case, like, literal_positions
from wildloom.functions.text import code_points, is_text, strict_text, valid_text

__all__ = ["any_like", "code_points", "first_case", "is_text", "like", "literal_positions", "strict_text", "valid_text"]

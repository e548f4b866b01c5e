"""The rule language as text: ``parse`` reads it, ``unparse`` writes it."""

from .parser import Source, SyntaxError_, parse
from .unparse import unparse, unparse_expr

__all__ = ["Source", "SyntaxError_", "parse", "unparse", "unparse_expr"]

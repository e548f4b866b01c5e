"""The selector and the seven operators."""

from .execute import Outcome, execute

__all__ = ["Outcome", "execute"]

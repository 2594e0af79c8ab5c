"""SQL statements that state, independently, what every registered job must return."""

from oracles.statements import statements

__all__ = ["statements"]

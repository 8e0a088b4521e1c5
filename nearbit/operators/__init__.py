"""Join strategies, pair comparison and discard-mode sinks."""

from nearbit.operators.strategies import STRATEGIES, Spec

__all__ = ["STRATEGIES", "Spec"]

"""Spark-native Hamming similarity joins over fixed-length bit strings."""

from nearbit.api import compare_pairs, explain_cost, hamming_self_join

__all__ = ["compare_pairs", "explain_cost", "hamming_self_join"]

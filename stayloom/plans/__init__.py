"""The study flows, as configurations of the operators."""

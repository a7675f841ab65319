"""Whole jobs composed from the operators: threshold, round, fit, experiment grid."""

"""Genotype operators: normalize, quality control, keys, matching, confidence, ancestry."""

"""Operators over genotype, pedigree and result tables."""
